"""Feed enrichment on Spark: select, prompt, parse, score, merge and export product feeds.

The package is layered so that each layer only uses the ones above it:

* ``functions``  column expressions (text, JSON, prompts, answers, scoring, HTML, vectors)
* ``operators``  DataFrame -> DataFrame steps (selection, numbering, joins, generation, ...)
* ``sources``    readers and writers
* ``plans``      whole jobs (batched updates, review of a feed, single-column enrichment)
* ``catalog``    the queries registered for checking, over the given test tables
"""

from feedlift.config import (
    DescriptionSettings,
    FeedConfig,
    ModelParams,
    Status,
    TitleSettings,
)

__all__ = ["DescriptionSettings", "FeedConfig", "ModelParams", "Status", "TitleSettings"]
