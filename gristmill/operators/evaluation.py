"""From questions to prompts: filtering, framework detection, contexts, and the product of models, modes and questions."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators.skew import HOT_ROWS, numbered, split_join

MODES = ("no_context", "full_framework", "rag")
BLOCK_CHARS = 1 << 20  # of one block of a context
# fixed values: the prompts without and with a context
ASK = "Question: {q}\n\nPlease provide a precise answer based on your knowledge of cybersecurity frameworks and compliance requirements."
ASK_WITH = "Context:\n{c}\n\nQuestion: {q}\n\nPlease provide a precise answer based on the context provided. Be specific about which requirements or controls are relevant."
# fixed values: the folder of each detected framework
FOLDERS = {
    "nist_csf": "nist-csf", "soc_2": "soc2-trust-services", "cmmc": "cmmc", "nist_800_53": "nist-800-53", "nist_800_171": "nist-800-171", "pci_dss": "pci-dss",
    "hipaa": "hipaa", "gdpr": "gdpr", "fedramp": "fedramp", "cjis": "cjis", "new_jersey_state": "new-jersey-state",
}


def filter_questions(questions: DataFrame, **wanted: str) -> DataFrame:
    """Equality on difficulty, category and question_type, membership in the comma list on framework; other names are ignored."""
    for name, value in wanted.items():
        if name in ("difficulty", "category", "question_type"):
            questions = questions.filter(F.col(f"metadata.{name}") == value)
        elif name == "framework":
            questions = questions.filter(F.array_contains(F.transform(F.split("metadata.framework", ","), T.strip), value))
    return questions


def prompt(question: Column, context: Column | None = None) -> Column:
    plain = F.replace(F.lit(ASK), F.lit("{q}"), question)
    if context is None:
        return plain
    with_context = F.replace(F.replace(F.lit(ASK_WITH), F.lit("{c}"), context), F.lit("{q}"), question)
    return F.when(context.isNotNull() & (context != ""), with_context).otherwise(plain)


def evaluation_plan(questions: DataFrame, models: list[str], modes: tuple[str, ...] = MODES) -> DataFrame:
    """Every question once for each model and mode. Models and modes are short lists that each question row carries; nothing is joined."""
    pairs = F.array(*(F.struct(F.lit(m).alias("model_name"), F.lit(o).alias("mode")) for m in models for o in modes))
    return questions.select("*", F.inline(pairs)) if models and modes else questions.select("*", F.lit("").alias("model_name"), F.lit("").alias("mode")).limit(0)


def _walk_contexts(chunks: DataFrame, by: list[str], order: str, text: str, block_chars: int | None) -> DataFrame:
    """Documents laid out by name and sorted, then read once from front to back; a task holds one Arrow batch and one block."""
    kinds = ", ".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in by)
    columns = f"{kinds}, block long, context string, parts long, context_chars long, context_md5 string"

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*by, "block", "context", "parts", "context_chars", "context_md5"]
        types: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for batch in stream:
                types[:] = [c.type for c in batch.columns[: len(by)]]
                for at in range(0, batch.num_rows, 1024):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns))

        def walk() -> Iterator[tuple]:
            for name, pieces in groupby(rows(), lambda r: r[:-1]):
                digest, parts, chars, block, held, size, texts = hashlib.md5(usedforsecurity=False), 0, 0, 0, [], 0, 0
                for *_, piece in pieces:
                    parts += 1
                    if piece is None or name[-1] is None:
                        continue
                    piece = ("\n\n" if texts else f"## {name[-1]}\n") + piece
                    texts += 1
                    digest.update(piece.encode("utf-8"))
                    chars += len(piece)
                    if block_chars is not None:
                        if held and size + len(piece) > block_chars:
                            yield *name, block, "".join(held), None, None, None
                            block, held, size = block + 1, [], 0
                        held.append(piece)
                        size += len(piece)
                yield *name, block, "".join(held) if held else None, parts, chars if texts else None, digest.hexdigest() if texts else None

        def packed(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*types, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()])], names=names)

        out, size = [], 0
        for row in walk():
            out.append(row)
            size += len(row[len(by) + 1] or "")
            if len(out) >= 1024 or size >= (block_chars or 1):
                yield packed(out)
                out, size = [], 0
        if out:
            yield packed(out)

    laid = chunks.select(*by, order, text).repartition(*by).sortWithinPartitions(*by, F.col(order).asc_nulls_last(), text)
    return laid.select(*by, text).mapInArrow(run, columns)


def context_blocks(chunks: DataFrame, by: list[str], order: str, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(by, block, context, parts, context_chars, context_md5): the context of each document, of any size, in numbered blocks from 0 on.

    Joined in order, with nothing between, the blocks are the context. A block holds whole pieces, at most ``block_chars`` characters
    or one longer piece. The last block of a document also carries the number of its pieces and the length and digest of the whole context.
    """
    return _walk_contexts(chunks, by, order, text, block_chars)


def context_digests(chunks: DataFrame, by: list[str], order: str, text: str = "text") -> DataFrame:
    """(by, parts, context_chars, context_md5) of the whole context of each document, of any size, without gathering it."""
    return _walk_contexts(chunks, by, order, text, None).select(*by, "parts", "context_chars", "context_md5")


def search_contexts(results: DataFrame, query: str, rank: str, framework: str, text: str, n: int = 3) -> DataFrame:
    """(query, context): ``[framework] text`` of the first ``n`` results by rank, joined by blank lines; at most ``n`` rows meet in a group."""
    first = results.filter(F.col(rank) <= n).select(query, F.struct(F.col(rank).alias("r"), F.concat(F.lit("["), F.col(framework), F.lit("] "), F.col(text)).alias("t")).alias("x"))
    return first.groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.t), "\n\n").alias("context"))


def enabled_modes(no_context: bool = True, full_framework: bool = True, rag: bool = True) -> tuple[str, ...]:
    """The modes that are switched on; all of them if none is."""
    return tuple(m for m, on in zip(MODES, (no_context, full_framework, rag)) if on) or MODES


def first_n(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first ``n`` models or questions by ``order``; all of them without ``n``."""
    return df if n is None else df.orderBy(*order).limit(n)


def select_contexts(questions: DataFrame, available: DataFrame, key: str = "question_id", text: str = "input", name: str = "framework_name", folders: bool = False) -> DataFrame:
    """(key, pos, name) of the frameworks whose contexts a question gets: those it mentions that are there, in fixed order; without any the first by name.

    ``available`` has a row for each framework, whose names are at most as many as those known. ``folders`` looks them up by their folder. Contexts themselves stay apart, as
    digests or blocks, to be met by name: a whole framework for every question would be far larger than either.
    """
    known = sorted(r[0] for r in available.select(name).filter(F.col(name).isin([*FOLDERS, *FOLDERS.values()]) | F.lit(not folders)).distinct().orderBy(name).limit(len(FOLDERS) * 100).collect() if r[0] is not None)
    detected = T.detect_frameworks(F.coalesce(F.col(text), F.lit("")))
    if folders:
        places = F.create_map(*(F.lit(x) for kv in FOLDERS.items() for x in kv))
        detected = F.transform(detected, lambda d: places[d])
    there = F.filter(detected, lambda d: d.isin(known)) if known else F.array().cast("array<string>")
    chosen = F.when(F.size(there) > 0, there).otherwise(F.array(*(F.lit(x) for x in known[:1])).cast("array<string>"))
    return questions.select(key, F.posexplode(chosen).alias("pos", name))


def backoff_seconds(attempt: int, base: float = 2.0, most: float = 60.0) -> float:
    """Pause after failed attempt number ``attempt``, from 0: 1, 2, 4 ... times, never over ``most``."""
    return min(most, base**attempt)


def with_retries(call: Callable[[], str], attempts: int = 3, base: float = 2.0, most: float = 60.0, pause: Callable[[float], None] = time.sleep) -> str:
    """The result of ``call``, tried up to ``attempts`` times with growing pauses; the last error is raised."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001  whatever a client raises
            if attempt == attempts - 1:
                raise
            pause(backoff_seconds(attempt, base, most))
    raise ValueError("needs at least one attempt")


def first_working(*clients: Callable[[str, str], str]) -> Callable[[str, str], str]:
    """A client that asks the first, and each next one where those before fail; the last error is raised."""
    def ask(name: str, text: str) -> str:
        for at, client in enumerate(clients):
            try:
                return client(name, text)
            except Exception:  # noqa: BLE001  whatever a client raises
                if at == len(clients) - 1:
                    raise
        raise ValueError("needs at least one client")

    return ask


def call_models(plan: DataFrame, client: Callable[[str, str], str], prompt_column: str = "prompt", model_column: str = "model_name", attempts: int = 3, parallel: int = 5, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Adds model_response from ``client(model, prompt)``, at most ``parallel`` calls of a task at once.

    A call that fails ``attempts`` times, or returns nothing, becomes a ``MODEL_FAILURE:`` response; a row whose call cannot even be made, for want of a
    model or prompt, becomes ``TASK_FAILURE:``. No exception reaches the task.
    """
    @F.pandas_udf("string")
    def respond(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(name: str | None, text: str | None) -> str:
            if name is None or text is None:
                return "TASK_FAILURE: no model or no prompt"
            try:
                found = (with_retries(lambda: client(name, text), attempts, pause=pause) or "").strip()
                return found or "MODEL_FAILURE: Model returned empty response"
            except Exception as error:  # noqa: BLE001
                return f"MODEL_FAILURE: Model query failed after {attempts} attempts: {error}"

        with ThreadPoolExecutor(parallel) as pool:
            for names, prompts in parts:
                yield pd.Series(list(pool.map(one, names, prompts)), dtype="object")

    return plan.withColumn("model_response", respond(F.col(model_column), F.col(prompt_column)))


def judged(df: DataFrame, judge: Callable[[str], str], response: str = "model_response", prompt_column: str = "judge_prompt", attempts: int = 3, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """Adds judge_score and judge_error: an invalid response scores 0 without being asked about; else the score that the judge's reply states.

    The judge is tried ``attempts`` times; an error, or a reply without a score, scores 0 and is reported.
    """
    from gristmill.functions.scoring import invalid_reason

    asked = df.withColumn("_invalid", invalid_reason(F.col(response))).withColumn("_model", F.lit("judge")).withColumn("_prompt", F.when(F.col("_invalid").isNull(), F.coalesce(F.col(prompt_column), F.lit(""))))
    replies = call_models(asked.withColumnRenamed(response, "_response"), lambda _, text: judge(text), "_prompt", "_model", attempts, pause=pause).withColumnRenamed("model_response", "_reply").withColumnRenamed("_response", response)
    failed = F.col("_reply").startswith("MODEL_FAILURE:")
    score = F.when(failed | F.col("_invalid").isNotNull(), F.lit(0.0)).otherwise(F.coalesce(T.parse_score(F.col("_reply")), F.lit(0.0)))
    error = F.coalesce(F.concat(F.lit("invalid response: "), F.col("_invalid")), F.when(failed, F.col("_reply")), F.when(T.parse_score(F.col("_reply")).isNull(), F.lit("no score in reply")))
    return replies.select(*df.columns, score.alias("judge_score"), error.alias("judge_error"))


def with_progress(df: DataFrame, by: list[str], order: list, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds done (rows of the group so far) and progress in percent, in the given order."""
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    placed = numbered(df, by, order, "done", hot_rows)
    return split_join(placed, totals.select(*by, F.col("n").alias("_all")), by, totals, hot_rows, null_safe=by).withColumn("progress", F.col("done") * 100.0 / F.col("_all")).drop("_all")
