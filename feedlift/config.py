"""Settings of a run. Everything here is frozen: a plan is built once from it."""

from __future__ import annotations

from dataclasses import dataclass, field


class Status:
    """Outcome written to the ``status`` column of a review row (fixed values)."""

    SUCCESS = "Success"
    FAILED = "Failed"
    NON_COMPLIANT = "Failed compliance checks"


# Fixed limits of the shopping feed specification, in UTF-16 units.
TITLE_MAX_LENGTH = 150
DESCRIPTION_MAX_LENGTH = 5000


@dataclass(frozen=True)
class ModelParams:
    """Decoding parameters handed to a completer and written into requests."""

    temperature: float = 0.1
    max_output_tokens: int = 2048
    top_k: int | None = None
    top_p: float | None = None

    def as_dict(self) -> dict[str, float | int]:
        values = {
            "temperature": self.temperature,
            "maxOutputTokens": self.max_output_tokens,
            "topK": self.top_k,
            "topP": self.top_p,
        }
        return {k: v for k, v in values.items() if v is not None}


@dataclass(frozen=True)
class TitleSettings:
    prompt: str = ""
    min_approval_score: float = 0.0
    use_page_text: bool = False
    prefer_generated_values: bool = False
    use_model_titles: bool = False
    # Comma separated words that may appear in a new title without being in the row.
    allowed_words: str = ""
    # Written into requests with images; a completer for plain prompts has its own.
    params: ModelParams = field(default_factory=ModelParams)

    def allowed(self) -> list[str]:
        return [w.strip().lower() for w in self.allowed_words.split(",") if w]


@dataclass(frozen=True)
class DescriptionSettings:
    prompt: str = ""
    min_approval_score: float = 0.0
    use_page_text: bool = False
    params: ModelParams = field(default_factory=ModelParams)


@dataclass(frozen=True)
class FeedConfig:
    """Column names of the feed and the switches of a review run."""

    id_col: str = "id"
    title_col: str = "title"
    description_col: str = "description"
    image_col: str = "image_link"
    generate_titles: bool = True
    generate_descriptions: bool = True
    # Send requests with the image of the row instead of plain prompts.
    use_images: bool = False
    title: TitleSettings = field(default_factory=TitleSettings)
    description: DescriptionSettings = field(default_factory=DescriptionSettings)
    # Put before the name of an exported attribute that no input column carries.
    new_attribute_prefix: str = "new-"

    def __post_init__(self) -> None:
        if len({self.id_col, self.title_col, self.description_col}) < 3:
            raise ValueError("id, title and description must be three different columns")
