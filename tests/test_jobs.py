"""Generation, batched runs, single-column runs, files."""

from __future__ import annotations

import shutil
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedlift.catalog.warehouse import prompt_reader
from feedlift.config import FeedConfig, ModelParams
from feedlift.functions import prompts
from feedlift.functions.responses import stream_response
from feedlift.functions.scoring import feed_text
from feedlift.functions.sql import create_functions
from feedlift.functions.text import id_part
from feedlift.operators import joins
from feedlift.operators.generation import (
    ExpressionCompleter,
    FunctionCompleter,
    RawCompleter,
    ReplayCompleter,
    call_with_retries,
    describe_images,
    embed_text,
    generate_text,
)
from feedlift.operators.quality import semantic_drift
from feedlift.operators.selection import init_state
from feedlift.operators.table_functions import table_function
from feedlift.plans import batched
from feedlift.plans.batched import BatchOptions, batched_update
from feedlift.plans.enrich import collect_batch, enrich_column, join_column, write_batch
from feedlift.plans.review_feed import review_feed
from feedlift.session import discard, materialise, path_exists, scratch, workspace
from feedlift.sources import feeds, requests
from feedlift.sources.tables import BucketedRows, StateTable, VersionedTable

# --- generation --------------------------------------------------------------------


def test_retries_end_with_the_last_error():
    calls = []

    def fail():
        calls.append(1)
        raise ValueError(len(calls))

    with pytest.raises(ValueError, match="3"):
        call_with_retries(fail, 3)
    assert call_with_retries(lambda: "x", 3) == "x"


def test_function_completer_marks_failures_and_skips_null(spark):
    def model(texts, params):
        if any("bad" in t for t in texts):
            raise RuntimeError("no quota")
        return [None if t == "blocked" else f"{t}:{params.temperature}" for t in texts]

    df = spark.createDataFrame(
        [(1, "a"), (2, "bad"), (3, None), (4, "blocked")], "id int, prompt string"
    )
    completer = FunctionCompleter(
        model, ModelParams(temperature=0.5), concurrency=2, partitions=3, attempts=2
    )
    found = {r.id: (r.response, r.error) for r in generate_text(df, completer).collect()}
    assert found == {
        1: ("a:0.5", None),
        2: (None, "RuntimeError: no quota"),
        3: (None, None),
        4: (None, None),
    }


def test_one_failing_prompt_fails_only_its_call(spark):
    def model(texts, params):
        if "bad" in texts:
            raise RuntimeError("x")
        return texts[:1] if "short" in texts else texts

    df = spark.createDataFrame([(p,) for p in ("a", "b", "bad", "c", "short", "d")], "prompt string")
    completer = FunctionCompleter(model, batch_size=2, attempts=1)
    found = {r.prompt: r.error for r in generate_text(df.coalesce(1), completer).collect()}
    assert [p for p, e in found.items() if e is None] == ["a", "b"]


def test_a_table_function_answers_the_rows_of_a_query(spark):
    def model(texts, params):
        if "bad" in texts:
            raise RuntimeError("x")
        return [f"{t}:{params.temperature}:{params.max_output_tokens}" for t in texts]

    spark.udtf.register("ask", table_function(FunctionCompleter(model, batch_size=2, concurrency=2, attempts=1)))
    rows = spark.createDataFrame([(i, p, None) for i, p in enumerate(["a", None, "bad", "c", "d", "e", "f"])], "id int, prompt string, x string").coalesce(1)
    got = spark.sql("SELECT * FROM ask(TABLE(SELECT * FROM {rows}), temperature => 0.5, max_output_tokens => 9)", rows=rows)
    assert got.columns == ["id", "prompt", "x", "response", "error"]
    found = {r.id: (r.response, r.error) for r in got.collect()}
    failed = (None, "RuntimeError: x")
    assert found == {0: failed, 1: (None, None), 2: failed, **{i: (f"{p}:0.5:9", None) for i, p in ((3, "c"), (4, "d"), (5, "e"), (6, "f"))}}
    assert spark.sql("SELECT * FROM ask(TABLE(SELECT * FROM {rows}))", rows=rows.limit(0)).count() == 0
    with pytest.raises(Exception, match="column prompt"):
        spark.sql("SELECT * FROM ask(TABLE(SELECT id FROM {rows}))", rows=rows)
    with pytest.raises(Exception, match="named like the answers"):
        spark.sql("SELECT * FROM ask(TABLE(SELECT prompt, id AS error FROM {rows}))", rows=rows)


def test_sql_functions_give_the_text_of_the_columns(spark):
    words = prompts.BatchWording("It's {language}\\ ", "in\n", "\tout ", "a 'quote' \"x\"", "end")
    create_functions(spark, {"title": words})
    rows = spark.createDataFrame(
        [(["p1", None, "p'2"], [("1", "{}", "t", None), ("2", None, None, "d")], 'say "x"'), ([], None, None)],
        "properties array<string>, examples array<struct<id:string,properties:string,title:string,description:string>>, text string",
    )
    by_sql = spark.sql(
        "SELECT titles_prompt('German', examples, properties) a, descriptions_prompt('German', examples, properties) b, "
        "feed_text(text, true) c, feed_text(text, false) d, id_part(text, 7) e FROM {rows}", rows=rows,
    )
    columns = rows.select(
        prompts.batch_prompt("title", "German", "properties", F.col("examples"), words).alias("a"),
        prompts.batch_prompt("description", "German", "properties", F.col("examples")).alias("b"),
        feed_text("text", True).alias("c"), feed_text("text", False).alias("d"), id_part("text", 7).alias("e"),
    )
    assert by_sql.collect() == columns.collect()


def test_embeddings_come_from_the_same_hook(spark):
    completer = FunctionCompleter(
        lambda texts, params: [[float(len(t)), 1.0] for t in texts], answer_type="array<float>"
    )
    df = spark.createDataFrame([("1", "abc")], "id string, content string")
    assert embed_text(df, completer).first().embedding == [3.0, 1.0]


def test_raw_answers_are_parsed_and_failures_kept(spark):
    def model(texts, params):
        if texts == ["down"]:
            raise OSError("net")
        return ['[{"candidates":[{"content":{"parts":[{"text":"a"}]}}]}]' if texts == ["ok"] else "[]"]

    df = spark.createDataFrame([("ok",), ("down",), ("empty",)], "prompt string")
    completer = RawCompleter(FunctionCompleter(model, attempts=1), stream_response)
    found = {r.prompt: (r.response, r.error) for r in generate_text(df, completer).collect()}
    assert found == {
        "ok": ("a", None),
        "down": (None, "OSError: net"),
        "empty": (None, "the response holds no text: []"),
    }


def test_review_sends_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"12")
    files = feeds.read_images(spark, str(tmp_path), with_content=True)
    link = files.first().uri
    feed = spark.createDataFrame(
        [("1", "t", "d", link), ("2", "t", "d", "gs://b/c.png"), ("3", "t", "d", None)],
        "id string, title string, description string, image_link string",
    )
    echo = ExpressionCompleter(lambda request: request)
    found = review_feed(feed, FeedConfig(use_images=True), echo, echo, images=files)
    sent = {r.item_id: r.full_response for r in found.collect()}
    assert '"inlineData":{"mimeType":"image/png","data":"MTI="}' in sent["1"]
    assert '"fileUri":"gs://b/c.png"' in sent["2"]
    assert "Data" not in sent["3"]


def test_replay_keeps_one_row_per_prompt(spark):
    stored = spark.createDataFrame([("a", "2"), ("a", "1"), ("b", "3")], "k string, response string")
    df = spark.createDataFrame([("a", "p"), ("c", "q")], "k string, prompt string")
    found = generate_text(df, ReplayCompleter(stored, ["k"])).collect()
    assert sorted((r.k, r.response) for r in found) == [("a", "1"), ("c", None)]


# --- batched runs ------------------------------------------------------------------


def run(spark, tmp_path, n, completer, options, state=None):
    inputs = spark.range(n).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), "id").alias("title")
    )
    table = StateTable(spark, str(tmp_path / "state"))
    table.create(init_state(inputs) if state is None else state)
    counts = batched_update(table, inputs, None, completer, options)
    return counts, {r.id: r for r in table.read().collect()}, table


def test_small_rounds_reach_everything(spark, tmp_path):
    options = BatchOptions("title", items_per_prompt=4, items_per_iteration=30)
    counts, state, table = run(spark, tmp_path, 100, prompt_reader("title"), options)
    for i, row in state.items():
        digit = int(i) % 10
        assert row.title == (f"T{i}" if digit > 1 else None)
        assert row.tries == {0: 0, 1: 3}.get(digit, 1)
    assert sum(counts) == 80 + 30
    # All answers are kept as they came, by round.
    assert {r["round"] for r in table.answers().collect()} == set(range(len(counts)))


def test_blocked_answers_end_after_three_tries(spark, tmp_path):
    silent = ExpressionCompleter(lambda p: F.lit(None).cast("string"))
    counts, state, _ = run(spark, tmp_path, 25, silent, BatchOptions("title"))
    assert counts == [25, 25, 25]
    assert all(r.title is None and r.tries == 3 for r in state.values())


@pytest.mark.parametrize(("size", "rounds"), [(None, 1), (10, 3)])
def test_a_run_that_gets_nowhere_ends(spark, tmp_path, size, rounds):
    useless = ExpressionCompleter(lambda p: F.lit("nothing: of use"))
    options = BatchOptions("title", items_per_iteration=size)
    counts, state, table = run(spark, tmp_path, 25, useless, options)
    assert counts == [0] * rounds
    assert all(r.tries == 0 for r in state.values())
    # Each product was asked for once in this run; the next run asks again.
    assert table.answers().count() == 25
    inputs = spark.range(25).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"))
    assert batched_update(table, inputs, None, useless, options) == counts


def test_errors_of_a_round_are_kept(spark, tmp_path):
    def down(texts, params):
        raise RuntimeError("down")

    options = BatchOptions("title", items_per_iteration=10)
    counts, state, table = run(spark, tmp_path, 12, FunctionCompleter(down, attempts=1), options)
    assert sum(counts) == 36
    assert all(r.title is None and r.tries == 3 for r in state.values())
    assert {r.error for r in table.answers().collect()} == {"RuntimeError: down"}


def files_of(table):
    """The files of each bucket of a state."""
    names = [r.f for r in table.rows().select(F.input_file_name().alias("f")).distinct().collect()]
    return {int(n.split("/bucket=")[1].split("/")[0]): n for n in names}


def test_a_round_replaces_its_buckets_alone(spark, tmp_path):
    options = BatchOptions("title", items_per_iteration=12, max_iterations=1)
    inputs = spark.range(200).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), "id").alias("title"))
    table = StateTable(spark, str(tmp_path / "state"), buckets=20)
    table.create(init_state(inputs))
    before = files_of(table)
    assert len(before) == 20
    for _ in range(3):
        batched_update(table, inputs, None, prompt_reader("title"), options)
        after = files_of(table)
        changed = {b for b in before if before[b] != after[b]}
        asked = {r["bucket"] for r in table.rows().where("tries > 0 or silent_in is not null").select("bucket").distinct().collect()}
        assert 1 <= len(changed) <= 3 and changed <= asked
        before = after
    assert table.read().count() == 200 and table.answers().count() == 36


class Watching:
    """Notes the tasks that hold the prompts of each round, and calls back before each."""

    def __init__(self, before=lambda round_no: None):
        self.tasks, self.before = [], before

    def complete(self, df, prompt, response, error):
        self.before(len(self.tasks))
        self.tasks.append(df.select(F.spark_partition_id()).distinct().count())
        return prompt_reader("title").complete(df, prompt, response, error)


@pytest.mark.parametrize("size", [None, 60])
def test_examples_are_read_once_in_a_run(spark, tmp_path, size):
    def gone(round_no):
        if round_no == 1:
            shutil.rmtree(tmp_path / "examples")

    spark.createDataFrame([("1", "{}", "a", "b")], "id string, properties string, title string, description string").write.parquet(str(tmp_path / "examples"))
    examples = spark.read.parquet(str(tmp_path / "examples"))
    inputs = spark.range(100).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), "id").alias("title"))
    table, seen = StateTable(spark, str(tmp_path / "state")), Watching(gone)
    table.create(init_state(inputs))
    counts = batched_update(table, inputs, examples, seen, BatchOptions("title", items_per_iteration=size))
    assert len(seen.tasks) == len(counts) >= 3 and sum(counts) == 80 + 30


def test_prompts_of_a_round_are_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batched, "PROMPTS_PER_TASK", 5, raising=False)
    seen = Watching()
    inputs = spark.range(200).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), "id").alias("title"))
    table = StateTable(spark, str(tmp_path / "state"))
    table.create(init_state(inputs))
    batched_update(table, inputs, None, seen, BatchOptions("title", items_per_prompt=10, max_iterations=2))
    assert seen.tasks[0] >= 2 and seen.tasks[1] == 1  # 20 prompts, then those of the 40 products that are left


def test_parts_side_by_side(spark, tmp_path):
    inputs = spark.range(40).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), "id").alias("title"))
    table = StateTable(spark, str(tmp_path / "state"), buckets=6)
    table.create(init_state(inputs))
    with ThreadPoolExecutor(3) as pool:
        runs = [pool.submit(batched_update, table, inputs, None, prompt_reader("title"), BatchOptions("title", parts=3, part=p, items_per_iteration=5)) for p in range(3)]
        counts = [r.result() for r in runs]
    assert sum(map(sum, counts)) == 32 + 12
    assert sum(r.title is not None for r in table.read().collect()) == 32
    with pytest.raises(ValueError, match="divide"):
        batched_update(table, inputs, None, prompt_reader("title"), BatchOptions("title", parts=4, part=0))


def test_buckets_of_any_rows(spark, tmp_path):
    rows = BucketedRows(spark, str(tmp_path / "rows"), 5)
    rows.create(spark.createDataFrame([], "id string, n int"))
    assert rows.rows().count() == 0 and rows.rows([]).count() == 0
    rows.create(spark.createDataFrame([("a", 1), (None, 2), ("a", 1), ("b", None)], "id string, n int"))
    assert sorted((r.id or "", r.n or 0) for r in rows.rows().collect()) == [("", 2), ("a", 1), ("a", 1), ("b", 0)]
    rows.replace(rows.rows().drop("bucket").withColumn("n", F.col("n") + 10))
    assert sorted((r.id or "", r.n or 0) for r in rows.rows().collect()) == [("", 12), ("a", 11), ("a", 11), ("b", 0)]
    bucket = rows.rows().where("id = 'a'").first().bucket
    assert {r.bucket for r in rows.rows([bucket]).collect()} == {bucket}


def test_the_model_is_called_once_per_image_and_text(spark):
    def counting(name):
        calls = spark.sparkContext.accumulator(0)

        def ask(texts, params):
            calls.add(len(texts))
            return [name for _ in texts]

        return ask, calls

    files = spark.createDataFrame([(f"gs://b/{i}.png",) for i in range(10)], "uri string")
    feed = files.select(F.concat(F.lit("u/"), F.regexp_extract("uri", "([^/]+)$", 1)).alias("image_link"))
    for join in (joins.join_images_by_name, joins.join_images_containing):
        ask, calls = counting("d")
        joined = join(feed, describe_images(files, FunctionCompleter(ask)))
        assert joined.where("image_description = 'd'").count() == 10
        assert calls.value == 10
    ask, calls = counting([1.0, 0.0])
    embedder = FunctionCompleter(ask, answer_type="array<double>")
    state = spark.createDataFrame([(str(i), f"n{i}") for i in range(6)], "id string, title string")
    drift = semantic_drift(state, state, embedder, size=4)
    assert drift.collect() == drift.collect()
    assert calls.value == 8


def test_images_that_cannot_be_sent_are_not_asked_about(spark):
    files = spark.createDataFrame([("s3a://b/a.png",), ("gs://b/b.png",), (None,)], "uri string")
    seen = describe_images(files, ExpressionCompleter(lambda p: F.lit("made up")))
    got = {r.uri: (r.description, r.error) for r in seen.collect()}
    assert got["gs://b/b.png"] == ("made up", None)
    assert got["s3a://b/a.png"][0] is None and "not read" in got["s3a://b/a.png"][1]
    assert got[None][0] is None


def test_products_without_input_do_not_block(spark, tmp_path):
    ids = init_state(spark.range(50))
    options = BatchOptions("title", items_per_iteration=10)
    counts, state, _ = run(spark, tmp_path, 20, prompt_reader("title"), options, ids)
    assert all(state[str(i)].tries == 0 for i in range(20, 50))
    assert state["2"].title == "T2"


def test_ids_are_done_once_even_when_finished(spark, tmp_path):
    done = init_state(spark.range(20)).withColumn("title", F.lit("old")).withColumn("tries", F.lit(3))
    options = BatchOptions("title", ids=["2", "3", "1"])
    counts, state, _ = run(spark, tmp_path, 20, prompt_reader("title"), options, done)
    assert counts == [3]
    assert (state["2"].title, state["2"].tries) == ("T2", 4)
    assert (state["1"].title, state["1"].tries) == ("old", 4)
    assert (state["4"].title, state["4"].tries) == ("old", 3)


def test_parts_are_worked_on_separately(spark, tmp_path):
    first = BatchOptions("title", parts=2, part=0)
    _, state, table = run(spark, tmp_path, 60, prompt_reader("title"), first)
    some = {i for i, r in state.items() if r.tries}
    inputs = spark.range(60).select(
        F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), "id").alias("title")
    )
    batched_update(table, inputs, None, prompt_reader("title"), BatchOptions("title", parts=2, part=1))
    every = {r.id for r in table.read().collect() if r.tries}
    assert 0 < len(some) < len(every) == 54


def test_examples_and_wording_reach_the_model(spark, tmp_path):
    seen = ExpressionCompleter(
        lambda p: F.concat(F.lit("0: "), F.regexp_replace(F.regexp_extract(p, "(TASK .*)", 1), ":", ""))
    )
    wording = prompts.BatchWording("TASK in {language}", "\n", "\n", "", "")
    options = BatchOptions("title", language="Dutch", wording=wording, max_iterations=1)
    _, state, _ = run(spark, tmp_path, 1, seen, options)
    assert state["0"].title == "TASK in Dutch"


ANSWERS = st.lists(
    st.sampled_from(["0: a", "1: b", "2", "9: x", "3", "junk", "4: ", "5: c\r", "0: again", ""]),
    max_size=8,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ANSWERS)
def test_a_round_never_loses_text_or_tries(spark, tmp_path_factory, lines):
    start = init_state(spark.range(6)).withColumn("title", F.when(F.col("id") < "3", F.lit("old")))
    ids = [str(i) for i in range(6)]
    options = BatchOptions("title", ids=ids, items_per_prompt=3, max_iterations=1)
    model = ExpressionCompleter(lambda p: F.lit("\n".join(lines)))
    _, state, _ = run(spark, tmp_path_factory.mktemp("s"), 6, model, options, start)
    assert sorted(state) == ids
    for i, row in state.items():
        mine = [x for x in lines if x.split(": ")[0] == i]
        assert row.tries == bool(mine)
        old = "old" if i < "3" else None
        assert row.title == (mine[0].split(": ", 1)[1] if mine and ": " in mine[0] else old)


# --- reviews and single columns with a Python model --------------------------------


def test_review_with_a_python_model(spark):
    def titles(texts, params):
        if '"id":"3"' in texts[0]:
            raise RuntimeError("down")
        return [
            "product attribute keys in original title: title\nproduct category: c\n"
            "product attribute keys: title\nproduct attribute values: x\ngenerated title: y"
        ]

    def texts_of(texts, params):
        return ["description: long\nscore: 0.7\nreasoning: good"]

    feed = spark.createDataFrame([(str(i), f"t {i}", "d") for i in range(5)], "id string, title string, description string")
    found = review_feed(
        feed, FeedConfig(), FunctionCompleter(titles), FunctionCompleter(texts_of), partitions=2
    )
    rows = {r.item_id: r for r in found.collect()}
    assert rows["3"].full_response == "RuntimeError: down"
    assert rows["1"].title_generated == "t 1" and rows["1"].approval
    assert rows["1"].full_response.endswith(
        "Product description: long\nDescription evaluation: Score: 0.7\ngood"
    )


def test_column_modes_and_predictions_without_id(spark):
    feed = spark.createDataFrame([("1", "red"), ("2", ""), ("3", None)], "id string, colour string")
    values = spark.createDataFrame(
        [("1", "a"), ("2", "b"), ("N/A", "c"), ("N/A", "d")], "id string, colour string"
    )
    def by_mode(mode):
        return {r.id: r.colour for r in join_column(feed, values, "colour", mode=mode).collect()}

    assert by_mode("fill") == {"1": "red", "2": "b", "3": None}
    assert by_mode("replace") == {"1": "a", "2": "b", "3": None}


def test_batch_run_in_two_halves(spark, tmp_path):
    feed = spark.createDataFrame(
        [("1", "a", "b"), ("2", "c", "d")], "id string, title string, description string"
    )
    cfg = FeedConfig()
    write_batch(feed, cfg, "colour", "English", str(tmp_path / "requests"))
    lines = spark.read.text(str(tmp_path / "requests"))
    assert lines.count() == 2
    response = '{"candidates":[{"content":{"parts":[{"text":"red"}]}}]}'
    (tmp_path / "out" / "run").mkdir(parents=True)
    with (tmp_path / "out" / "run" / "predictions.jsonl").open("w") as f:
        for r in lines.collect():
            f.write(r.value[:-1] + f',"response":{response}}}\n')
    path = collect_batch(feed, cfg, "colour", str(tmp_path / "out"))
    assert path.endswith("/run/feed_enriched.csv")
    found = feeds.read_feed_csv(spark, path, ["colour"])
    assert {(r.id, r.colour) for r in found.collect()} == {("1", "red"), ("2", "red")}


def test_enrich_with_quotes_and_number_ids(spark):
    feed = spark.createDataFrame([(1, 'say "x"', "d\n{")], "id long, title string, description string")
    def model(texts, params):
        assert '"Title: say \\"x\\""' in texts[0]
        return ['{"candidates":[{"content":{"parts":[{"text":"red"}]}}]}']

    row = enrich_column(feed, FeedConfig(), "colour", "English", FunctionCompleter(model)).first()
    assert (row.id, row.colour) == (1, "red")


def test_drift_of_equal_titles_is_zero(spark):
    inputs = spark.range(30).select(F.col("id").cast("string"), F.col("id").cast("string").alias("title"))
    state = init_state(inputs).withColumn("title", F.col("id"))
    embed = FunctionCompleter(
        lambda texts, params: [[float(t) + 1.0, 2.0] for t in texts], answer_type="array<float>"
    )
    found = semantic_drift(state, inputs, embed, size=10).collect()
    assert sum(r.products for r in found) == 10
    assert all(r.distance_bucket <= 0.1 for r in found)


# --- files and tables --------------------------------------------------------------


def test_workspace_is_the_session_setting(spark):
    assert workspace(spark) == spark.conf.get("spark.checkpoint.dir")


def test_scratch_frames_are_deleted(spark):
    def there(df):
        return path_exists(spark, df.inputFiles()[0].rsplit("/", 1)[0])

    with scratch(spark):
        with scratch(spark):
            inside = materialise(spark.range(100))
            result = materialise(spark.range(7), keep=True)
            assert inside.count() == 100
        assert (there(inside), there(result)) == (False, True)
    kept = materialise(spark.range(5))
    assert (there(result), there(kept)) == (False, True)
    discard(kept)
    assert not there(kept)


def test_unfinished_versions_are_not_seen(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.latest() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write(spark.range(3))
    (tmp_path / "t" / "version=2").mkdir()  # broken off
    assert table.read().count() == 3
    assert table.write(table.read().union(spark.range(1))).count() == 4
    assert table.latest() == 3
    assert table.clear().count() == 0
    assert table.read(1).count() == 3
    with pytest.raises(FileNotFoundError, match="9"):
        table.read(9)


def test_csv_feed(spark, tmp_path):
    (tmp_path / "f.csv").write_text('id,title,brand\n1,"a ""b"", c\nd",x\n,,\n2,,\n')
    feed = feeds.read_feed_csv(spark, str(tmp_path / "f.csv"), ["id", "title"], multi_line=True)
    assert [tuple(r) for r in feed.collect()] == [("1", 'a "b", c\nd', "x"), ("2", None, None)]
    with pytest.raises(ValueError, match="price"):
        feeds.read_feed_csv(spark, str(tmp_path / "f.csv"), ["price"])


def test_parquet_feed_without_empty_rows(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("", None)], "id string, t string")
    feeds.write_table(df, str(tmp_path / "p"))
    assert [tuple(r) for r in feeds.read_feed_parquet(spark, str(tmp_path / "p")).collect()] == [("1", "a")]


def test_tsv_keeps_marked_texts(spark, tmp_path):
    df = spark.createDataFrame([("1", 'm:"a ""b"""', "x\ty\nz", None)], "id string, t string, d string, n string")
    feeds.write_tsv(df.coalesce(1), str(tmp_path / "o"))
    lines = "".join(p.read_text() for p in (tmp_path / "o").glob("*.csv")).splitlines()
    assert lines == ["id\tt\td\tn", '1\tm:"a ""b"""\tx y z\t']


def test_images_of_all_types(spark, tmp_path):
    for name in ("a.png", "b.JPG", "c.gif", "d.jpeg"):
        (tmp_path / name).write_bytes(b"12")
    (tmp_path / "e").write_bytes(b"\x89PNG\r\n\x1a\n...")

    def kinds(**options):
        found = feeds.read_images(spark, str(tmp_path), **options).collect()
        return {r.uri.rsplit("/", 1)[1]: r.mime_type for r in found}

    # All files are there; those of another or an unknown type have none.
    by_name = {"a.png": "image/png", "b.JPG": "image/jpeg", "c.gif": None, "d.jpeg": "image/jpeg", "e": None}
    assert kinds() == by_name
    assert kinds(with_content=True) == by_name | {"e": "image/png"}
    assert set(kinds(mime_type="image/webp").values()) == {"image/webp"}
    whole = feeds.read_images(spark, str(tmp_path), with_content=True)
    request = prompts.multimodal_request(
        F.lit("p"), ModelParams(), F.col("uri"), F.col("mime_type"), F.col("content")
    )
    assert '"data":"MTI="' in whole.where("uri like '%/a.png'").select(request.alias("r")).first().r


def test_predictions_as_plain_file_of_the_last_run(spark, tmp_path):
    for run_name, text in (("run-1", "old"), ("run-2", "new")):
        (tmp_path / run_name).mkdir()
        (tmp_path / run_name / "predictions.jsonl").write_text(f'{{"status":"{text}"}}\n')
    (tmp_path / "run-3").mkdir()
    (tmp_path / "run-3" / "other.jsonl").write_text("{}")
    assert [r.status for r in requests.read_predictions(spark, str(tmp_path)).collect()] == ["new"]
    with pytest.raises(FileNotFoundError):
        requests.latest_predictions(spark, str(tmp_path / "none"))


def test_feed_position_over_several_files(spark, tmp_path):
    for i in range(3):
        rows = "".join(f"{i * 10 + j}\n" for j in range(10))
        (tmp_path / f"part{i}.csv").write_text("id\n" + rows)
    feed = spark.read.csv(str(tmp_path), header=True)
    found = feeds.with_feed_position(feed).collect()
    assert {int(r.id): r.feed_pos for r in found} == {i: i for i in range(30)}
