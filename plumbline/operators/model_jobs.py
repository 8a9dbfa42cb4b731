"""Jobs that call a user-supplied model, encoder, fetcher or scorer.

Each job takes a factory that is called once per partition inside the executor;
what it returns does the calls. Spark distributes the rows, the helpers below
only loop over one Arrow batch. They read the columns they need and put the
answers beside the batch as it came, so no other column is converted.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as t

from plumbline import registry as R
from plumbline.functions import parsing as P, vectors as V

CallModel = Callable[[str, str], str]
_FENCED = re.compile(r"```(?:json)?(.*?)(?:```.*)?", re.DOTALL)


def _spread(df: DataFrame, parallelism: int | None) -> DataFrame:
    """Deal rows to ``parallelism`` tasks (else the shuffle partitions) by a hash of their values.

    With the number given, adaptive execution does not fold few rows into one task. Only types
    that hash alike in every run are read; a repeated prompt is spread by the row's other values.
    """
    kinds = (t.StringType, t.IntegralType, t.DateType, t.TimestampType)
    keys = [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]
    number = parallelism or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(number, F.xxhash64(*[df[k] for k in keys]))


_ARROW = {"string": pa.string(), "array<float>": pa.list_(pa.float32()),
          "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def _with_answers(df: DataFrame, column: str, added: dict[str, str],
                  start: Callable[[], Callable[[list], list[list]]],
                  parallelism: int | None) -> DataFrame:
    """Add columns: ``start()`` gives a function from the values of one column to lists of theirs."""
    at = df.columns.index(column)
    names = [*df.columns, *added]
    schema = t.StructType([*df.schema.fields, *[
        t.StructField(name, t.StructType.fromDDL(f"x {kind}")[0].dataType) for name, kind in added.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = start()
        for batch in batches:
            found = answer(batch.column(at).to_pylist()) if batch.num_rows else [[] for _ in added]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(x, _ARROW[kind]) for x, kind in zip(
                    found, added.values(), strict=True)]], names)

    return _spread(df, parallelism).mapInArrow(run, schema)


def _at_once(work: Callable, values: list, in_flight: int) -> list:
    """``work`` of every value in order, at most ``in_flight`` at a time."""
    if in_flight <= 1:
        return [work(v) for v in values]
    with ThreadPoolExecutor(in_flight) as pool:
        return list(pool.map(work, values))


def _json_body(raw: str) -> str:
    """The answer without a Markdown fence; raises if it is not JSON."""
    text = raw.strip()
    fenced = _FENCED.fullmatch(text)
    body = fenced[1].strip() if fenced else text
    json.loads(body)
    return body


def _answer(call: CallModel, system: str, prompt: str, retries: int, wait: float,
            check: Callable[[str], str]) -> tuple[str | None, str | None]:
    error = None
    for attempt in range(retries):
        if attempt and wait:
            time.sleep(wait)
        try:
            return check(call(system, prompt)), None
        except Exception as problem:  # any failure of a remote call is retried
            error = f"{type(problem).__name__}: {problem}"
    return None, error


def call_model(df: DataFrame, prompt: str, system: str, client: Callable[[], CallModel],
               retries: int = R.MODEL_RETRIES, wait: float = R.MODEL_RETRY_WAIT,
               expect_json: bool = True, parallelism: int | None = None,
               in_flight: int = 1) -> DataFrame:
    """Add ``response`` and ``error``; the response is null if every try failed.

    At most ``parallelism`` times ``in_flight`` calls are under way: the number of tasks, and of
    calls that one task makes at a time, for which the function must be safe to call from threads.

    ``client()`` returns a function ``(system, prompt) -> text``. With
    ``expect_json`` an answer that is no JSON counts as a failed try.
    """
    check = _json_body if expect_json else (lambda raw: raw or "")

    def start():
        call = client()

        def answer(prompts: list[str]) -> list[list]:
            found = _at_once(lambda p: _answer(call, system, p, retries, wait, check), prompts, in_flight)
            return [[a for a, _ in found], [e for _, e in found]]

        return answer

    return _with_answers(df, prompt, {"response": "string", "error": "string"}, start, parallelism)


def classify(df: DataFrame, prompt: str, system: str, client: Callable[[], CallModel],
             parallelism: int | None = None, in_flight: int = 1) -> DataFrame:
    """One call per row without retry; an error gives the empty answer."""
    answered = call_model(df, prompt, system, client, retries=1, wait=0.0, expect_json=False,
                          parallelism=parallelism, in_flight=in_flight)
    return answered.withColumn("response", F.coalesce("response", F.lit("")))


def embed(texts: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], list]],
          batch_size: int = R.EMBED_BATCH, parallelism: int | None = None) -> DataFrame:
    """(text, vector) for every distinct text, encoded in small batches."""
    distinct = texts.select(text).filter(F.col(text).isNotNull()).distinct()
    return _with_answers(distinct, text, {"vector": "array<float>"},
                         lambda: _in_batches(encoder(), batch_size), parallelism)


def _in_batches(work: Callable[[list[str]], list], size: int) -> Callable[[list], list[list]]:
    def answer(values: list) -> list[list]:
        found = []
        for lo in range(0, len(values), size):
            found.extend(work(values[lo:lo + size]))
        return [[list(map(float, v)) for v in found]]

    return answer


def fetch_and_summarise(keys: DataFrame, query: Column,
                        worker: Callable[[], tuple[Callable[[str], list[str]],
                                                   Callable[[list[str], str], str]]],
                        parallelism: int | None = None, retries: int = 1, wait: float = 0.0,
                        in_flight: int = 1) -> DataFrame:
    """(keys…, snippets, summary, error) for distinct keys.

    ``worker()`` returns ``(fetch, summarise)``. Each is tried ``retries`` times. A failed fetch
    gives no snippets; no snippets, or a failed summary, gives ``NA``. ``error`` says what failed,
    so that a cache can ask again; it is null where a fetch just found nothing.
    """
    asked = keys.distinct().withColumn("_query", query)

    def start():
        fetch, summarise = worker()

        def tried(step: str, work: Callable):
            problem = None
            for attempt in range(max(1, retries)):
                if attempt and wait:
                    time.sleep(wait)
                try:
                    return work(), None
                except Exception as failure:  # any failure of a remote call is retried
                    problem = f"{step}: {type(failure).__name__}: {failure}"
            return None, problem

        def one(text: str) -> tuple[list[str], str, str | None]:
            snippets, problem = tried("fetch", lambda: list(fetch(text)))
            if not snippets:
                return [], "NA", problem
            note, problem = tried("summary", lambda: summarise(snippets, text).strip())
            return snippets, "NA" if note is None else note, problem

        return lambda texts: [list(x) for x in zip(*_at_once(one, texts, in_flight), strict=True)]

    added = {"snippets": "array<string>", "summary": "string", "error": "string"}
    return _with_answers(asked, "_query", added, start, parallelism).drop("_query")


def score_labels(df: DataFrame, text: str, scorer: Callable[[], Callable[[list[str]], list]],
                 labels: DataFrame, batch_size: int = R.EMBED_BATCH,
                 parallelism: int | None = None) -> DataFrame:
    """Add ``predicted_code``: the label with the largest score.

    ``scorer()`` returns a function from texts to one score list per text;
    ``labels`` is (label, label_id).
    """
    def start():
        score = _in_batches(scorer(), batch_size)
        return lambda values: score(["" if v is None else v for v in values])

    scored = _with_answers(df, text, {"scores": "array<double>"}, start, parallelism).withColumn(
        "label_id", V.argmax(F.col("scores")))
    names = labels.select(F.col("label").alias(R.PREDICTED_CODE), "label_id")
    return scored.join(names, "label_id", "left").drop("label_id", "scores")


def reconcile(df: DataFrame, anchors: str, response: str = "response",
              mode: str = "career") -> tuple[DataFrame, DataFrame]:
    """Model answers against the anchors they were asked for: (silver, failures).

    ``anchors`` is an array of structs with the index and the gold code. Answer
    and anchors of a case are in one row, so nothing is shuffled. Answers for
    an index that was not asked are ignored; a flagged or empty answer fails,
    and so does an anchor without answer.
    """
    spec = _ANSWERS[mode]
    wanted, code = spec["index"], spec["code"]
    indices = F.transform(F.col(anchors), lambda a: a[wanted])
    parsed = F.try_parse_json(F.col(response))
    items = F.filter(
        F.transform(P.json_items(parsed, f"$.{spec['items']}"), lambda item: F.struct(
            P.json_index(item, wanted).alias("index"),
            P.json_truthy(item, "extraction_failed").alias("failed"),
            *[P.json_field(item, label).alias(label) for label in spec["labels"]],
        )),
        lambda item: F.array_contains(indices, item["index"]),
    )
    base = df.select(
        R.CASE_ID, F.col(anchors).alias("_anchors"), F.col(response).alias("_response"),
        items.alias("_items"))

    def unusable(item: Column) -> Column:
        empty = F.lit(True)
        for label in spec["labels"]:
            empty = empty & item[label].isNull()
        return item["failed"] | empty

    good = base.select(
        R.CASE_ID, "_anchors", F.explode(F.filter("_items", lambda i: ~unusable(i))).alias("_i"))
    gold = F.filter("_anchors", lambda a: a[wanted] == F.col("_i.index"))[0][code]
    silver = good.select(
        R.CASE_ID, F.col("_i.index").alias(R.SPELL_INDEX), gold.alias(spec["gold_col"]),
        *[F.coalesce(F.col(f"_i.{label}"), F.lit("")).alias(label) for label in spec["labels"]])

    def failed(indexes: Column, reason: str) -> Column:
        return F.transform(indexes, lambda i: F.struct(
            i.cast("string").alias(R.SPELL_INDEX), F.lit(reason).alias("reason")))

    asked = F.transform("_anchors", lambda a: a[wanted])
    returned = F.transform("_items", lambda i: i["index"])
    rejected = F.transform(F.filter("_items", unusable), lambda i: i["index"])
    reasons = F.when(
        F.col("_response").isNull(), failed(asked, R.REASON_CALL_FAILED)
    ).otherwise(F.concat(
        failed(rejected, R.REASON_MODEL_FAILED),
        failed(F.array_except(asked, returned), R.REASON_NOT_RETURNED[mode])))
    failures = base.select(R.CASE_ID, F.inline(reasons))
    return silver, failures


_ANSWERS = {
    "career": {
        "items": "spells", "index": "spell_index", "code": "category",
        "gold_col": "career_position", "labels": ("job_description_label", "workplace_label"),
    },
    "education": {
        "items": "subjects", "index": "subject_index", "code": "code",
        "gold_col": "uni_subject", "labels": ("subject_label",),
    },
}
