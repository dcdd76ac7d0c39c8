"""The model step as a table function, for SQL users: a query goes in, its rows come out with the answers.

    spark.udtf.register("generate_text", table_function(FunctionCompleter(ask, batch_size=20)))
    SELECT * FROM generate_text(TABLE(SELECT chunk_id, ids, prompt FROM prompts), temperature => 0.1)

Store the result before it is used twice: the model may answer otherwise the next time.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from typing import Any

from pyspark.sql.functions import udtf
from pyspark.sql.types import Row, StringType, StructField, StructType
from pyspark.sql.types import _parse_datatype_string as parse_type
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, UserDefinedTableFunction

from feedlift.operators.generation import FunctionCompleter

_PARAMS = ("temperature", "max_output_tokens", "top_k", "top_p")


def table_function(completer: FunctionCompleter, prompt: str = "prompt", response: str = "response", error: str = "error") -> UserDefinedTableFunction:
    """A table function over any table with a column ``prompt``: all its columns, then ``response`` and ``error``. Decoding
    parameters may be named in the call; ``partitions`` of the completer does not apply, as the rows come from a query.

    Rows are answered as they stream by, ``batch_size`` prompts a call and ``concurrency`` calls at a time in a task."""

    kind = parse_type(completer.answer_type)

    class Generate:
        @staticmethod
        def analyze(
            rows: AnalyzeArgument, temperature: AnalyzeArgument | None = None, max_output_tokens: AnalyzeArgument | None = None,
            top_k: AnalyzeArgument | None = None, top_p: AnalyzeArgument | None = None,
        ) -> AnalyzeResult:
            if not rows.isTable or prompt not in rows.dataType.names:
                raise ValueError(f"the first argument must be a table with a column {prompt}")
            taken = {response, error} & set(rows.dataType.names)
            if taken:
                raise ValueError(f"the table has columns named like the answers: {sorted(taken)}")
            answers = [StructField(response, kind), StructField(error, StringType())]
            return AnalyzeResult(StructType([*rows.dataType.fields, *answers]))

        def __init__(self) -> None:
            self.waiting: list[Row] = []
            self.asked = completer
            self.pool: ThreadPoolExecutor | None = None

        def eval(self, rows: Row, temperature: Any = None, max_output_tokens: Any = None, top_k: Any = None, top_p: Any = None) -> Iterator[tuple]:
            if self.pool is None:
                given = dict(zip(_PARAMS, (temperature, max_output_tokens, top_k, top_p), strict=True))
                named = {k: (int(v) if k in ("max_output_tokens", "top_k") else float(v)) for k, v in given.items() if v is not None}
                self.asked = replace(completer, params=replace(completer.params, **named))
                self.pool = ThreadPoolExecutor(completer.concurrency)
            self.waiting.append(rows)
            if len(self.waiting) >= completer.batch_size * completer.concurrency:
                yield from self._flush()

        def terminate(self) -> Iterator[tuple]:
            yield from self._flush()
            if self.pool is not None:
                self.pool.shutdown()

        def _flush(self) -> Iterator[tuple]:
            if self.waiting:
                answers, errors = self.asked.answer([r[prompt] for r in self.waiting], self.pool)
                for row, found, problem in zip(self.waiting, answers, errors, strict=True):
                    yield (*row, found, problem)
                self.waiting = []

    return udtf(Generate)
