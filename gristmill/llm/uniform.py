"""Problem 10: one form of writing for texts that look the same."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.arrow import batches
from gristmill.operators.skew import split_join
from gristmill.session import cut_lineage

# fixed values: letters of other alphabets and the Latin letter of the same shape, as two aligned strings each
LOOK_ALIKES = (
    # Cyrillic
    ("АВЕКМНОРСТУХІЈЅԚԜѴӀҮԌ", "ABEKMHOPCTYXIJSQWVIYG"),
    ("аеорсухіјѕһԁԛԝӏѵү", "aeopcyxijshdqwlvy"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺϜͿ", "ABEZHIKMNOPTYXCMFJ"),
    ("οανρυικϲϳ", "oavpuikcj"),
    # Armenian and Cherokee
    ("ՕՍօոս", "OUonu"),
    ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ"),
    # Coptic and Lisu
    ("ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ", "HIKMNOPCTYX"),
    ("ⲟⲣⲥ", "opc"),
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
)
HOT_ROWS = 200_000
# only width, joined letters and kinds of space change; other compatibility forms look different
_TAGS = ("<wide>", "<narrow>", "<noBreak>")
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
_PLAIN = re.compile(r"[\n -~]*\Z")


@lru_cache(maxsize=1)
def mappings() -> dict[str, np.ndarray]:
    """Tables joined to the code points: what each maps to (nothing, one or several), mark classes, and compositions.

    They are made by rule from the character database and ``LOOK_ALIKES``; their size is bounded by the number of code points.
    """
    alike = {ord(a): ord(b) for left, right in LOOK_ALIKES for a, b in zip(left, right)}
    targets: dict[int, tuple[int, ...]] = {}
    classes: dict[int, int] = {}
    pairs: dict[tuple[int, int], int] = {}

    def expand(point: int) -> tuple[int, ...]:
        char = chr(point)
        kind = unicodedata.category(char)
        if point in (9, 0x0B, 0x0C) or kind == "Zs":
            return (32,)
        if point in (0x85, 0x2028, 0x2029):
            return (10,)
        if point in _INVISIBLE or kind == "Cf" or (kind == "Cc" and point != 10):
            return ()
        parts = unicodedata.decomposition(char).split()
        if not parts:
            return (alike.get(point, point),)
        if parts[0].startswith("<"):
            letters = parts[1:]
            joined = parts[0] == "<compat>" and len(letters) > 1 and kind.startswith("L") and all(unicodedata.category(chr(int(x, 16))).startswith("L") for x in letters)
            if parts[0] not in _TAGS and not joined:
                return (alike.get(point, point),)
            parts = letters
        return tuple(x for p in parts for x in expand(int(p, 16)))

    for point in range(128, sys.maxunicode + 1):
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF or 0xE000 <= point <= 0xF8FF or 0x4E00 <= point <= 0x9FFF or 0x20000 <= point <= 0x2F7FF or point >= 0xF0000:
            continue
        char = chr(point)
        if combining := unicodedata.combining(char):
            classes[point] = combining
        if (to := expand(point)) != (point,):
            targets[point] = to
        parts = unicodedata.decomposition(char).split()
        if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", char) == char:
            pairs[int(parts[0], 16), int(parts[1], 16)] = point
    for point in (*range(0, 10), *range(11, 32), 127):
        targets[point] = expand(point)
    keys = sorted(targets)
    sizes = [len(targets[k]) for k in keys]
    marked = {k: v for k, v in pairs.items() if k[1] in classes}
    composed = sorted((a << 21 | b, c) for (a, b), c in marked.items())
    marks = sorted(classes)
    return {
        "keys": np.array(keys, np.uint32), "sizes": np.array(sizes, np.int64), "starts": np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64), "flat": np.array([x for k in keys for x in targets[k]], np.uint32),
        "marks": np.array(marks, np.uint32), "classes": np.array([classes[m] for m in marks], np.int32),
        "pair_keys": np.array([k for k, _ in composed], np.int64), "pair_to": np.array([c for _, c in composed], np.uint32),
        "second_starters": np.array(sorted({b for (_, b) in pairs if b not in classes} | set(range(0x1161, 0x11C3))), np.uint32),
    }


def _look_up(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the values that are among the sorted keys, and where they are there."""
    place = np.searchsorted(keys, values)
    place[place == len(keys)] = 0
    hit = np.nonzero(keys[place] == values)[0]
    return hit, place[hit]


def _compose(points: np.ndarray, row: np.ndarray, tables: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order of the marks after each base, then composition of bases with their marks."""
    hit, place = _look_up(tables["marks"], points)
    if not len(hit):
        return points, row
    classes = np.zeros(len(points), np.int32)
    classes[hit] = tables["classes"][place]
    fresh = classes == 0
    fresh[0] = True
    fresh[1:] |= row[1:] != row[:-1]
    group = np.cumsum(fresh) - 1
    order = np.lexsort((classes, group))
    points, classes = points[order].copy(), classes[order]
    base = np.nonzero(fresh)[0]  # group sizes are unchanged, so groups begin where they did
    bounds = np.append(base, len(points))
    keep = np.ones(len(points), bool)
    live = np.nonzero((np.diff(bounds) > 1) & (classes[base] == 0))[0]
    blocked = np.zeros(len(base), np.int32)
    step = 1
    while len(live):
        at = base[live] + step
        pair = points[base[live]].astype(np.int64) << 21 | points[at]
        found, where = _look_up(tables["pair_keys"], pair)
        joined = np.zeros(len(live), bool)
        free = blocked[live[found]] < classes[at[found]]
        found, where = found[free], where[free]
        joined[found] = True
        points[base[live[found]]] = tables["pair_to"][where]
        keep[at[found]] = False
        blocked[live[~joined]] = classes[at[~joined]]
        step += 1
        live = live[bounds[live + 1] - base[live] > step]
    return points[keep], row[keep]


def uniform_texts(texts: list[str | None], tables: dict[str, np.ndarray] | None = None) -> list[str | None]:
    """Each text in its one form. Null stays null; plain ASCII text is that form already."""
    tables = tables or mappings()
    out = list(texts)
    todo = [i for i, t in enumerate(texts) if t and not (t.isascii() and _PLAIN.match(t))]
    if not todo:
        return out
    coded = [texts[i].encode("utf-32-le", "surrogatepass") for i in todo]
    points = np.frombuffer(b"".join(coded), np.uint32)
    row = np.repeat(np.arange(len(todo), dtype=np.int32), [len(c) // 4 for c in coded])
    unusual = np.nonzero((points > 126) | ((points < 32) & (points != 10)))[0]
    hit, place = _look_up(tables["keys"], points[unusual])
    hit = unusual[hit]
    sizes = np.ones(len(points), np.int64)
    sizes[hit] = tables["sizes"][place]
    if (sizes == 1).all():
        points = points.copy()
        points[hit] = tables["flat"][tables["starts"][place]]
    else:
        begins = np.cumsum(sizes) - sizes
        spread = np.repeat(points, sizes)
        width = sizes[hit]
        spans = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        spread[np.repeat(begins[hit], width) + spans] = tables["flat"][np.repeat(tables["starts"][place], width) + spans]
        points, row = spread, np.repeat(row, sizes)
    if len(points):
        points, row = _compose(points, row, tables)
    ends = np.cumsum(np.bincount(row, minlength=len(todo)))
    late, _ = _look_up(tables["second_starters"], points) if len(points) else (np.array([], np.int64), None)
    again = set(row[late].tolist())
    data, begin = points.tobytes(), 0
    for n, (i, end) in enumerate(zip(todo, ends.tolist())):
        text = data[4 * begin : 4 * end].decode("utf-32-le", "surrogatepass")
        out[i] = unicodedata.normalize("NFC", text) if n in again else text
        begin = end
    return out


def shared_tables(df: DataFrame):
    """The mapping tables as a broadcast variable; well under a megabyte, whatever the data."""
    return df.sparkSession.sparkContext.broadcast(mappings())


def uniform_column(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with every text in its one form; one row out per row in, nulls and empty texts as they are."""
    shared = shared_tables(df)
    kind = df.schema[key].dataType.simpleString()

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(uniform_texts(batch.column(1).to_pylist(), shared.value), pa.string())], names=["k", "text"])

    return df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def forms(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form, raw): 128-bit digests of the one form and of the text as written. Rows with null text are left out."""
    shared = shared_tables(df)
    kind = df.schema[key].dataType.simpleString()

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            texts = batch.column(1).to_pylist()
            raw = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
            form = [r if u is t or u == t else xxhash.xxh3_128_digest(u.encode("utf-8", "surrogatepass")) for t, u, r in zip(texts, uniform_texts(texts, shared.value), raw)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(form, pa.binary()), pa.array(raw, pa.binary())], names=["k", "form", "raw"])

    rows = df.filter(F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    return rows.mapInArrow(run, f"k {kind}, form binary, raw binary").withColumnRenamed("k", key)


def look_alike_classes(df: DataFrame, key: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: key, class_id (the smallest key that looks the same), members, written_forms.

    Classes are counted with partial sums, and a class that holds a large part of all rows takes its id by broadcast.
    """
    rows = cut_lineage(forms(df, key, text))
    classes = rows.groupBy("form").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("members"), F.countDistinct("raw").alias("written_forms"))
    return split_join(rows, classes, ["form"], classes.select("form", F.col("members").alias("n")), hot_rows).select(key, "class_id", "members", "written_forms")


def _written_pairs(writings: DataFrame, block: int) -> DataFrame:
    """(a, na, b, nb): every two writings of one form, as digests with their numbers of rows. A form of many writings is cut into blocks that meet two by two."""
    many = writings.groupBy("form").agg(F.count(F.lit(1)).alias("_w")).filter("_w > 1")
    slices = F.ceil(F.col("_w") / block).cast("int")
    laid = writings.join(many, "form").withColumn("_s", slices).withColumn("_blk", F.pmod(F.xxhash64("raw"), F.col("_s")).cast("int"))
    left = laid.select("form", F.col("raw").alias("a"), F.col("n").alias("na"), F.col("_blk").alias("_i"), F.explode(F.sequence("_blk", F.col("_s") - 1)).alias("_j"))
    right = laid.select("form", F.col("raw").alias("b"), F.col("n").alias("nb"), F.explode(F.sequence(F.lit(0), "_blk")).alias("_i"), F.col("_blk").alias("_j"))
    return left.join(right, ["form", "_i", "_j"]).filter((F.col("_i") < F.col("_j")) | (F.col("a") < F.col("b"))).select("a", "na", "b", "nb")


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS, block: int = 2048) -> DataFrame:
    """(key_a, key_b), smaller first, of texts that differ in characters but look the same; every such pair once.

    Writings meet writings first, so equal copies are never compared with one another. Then each pair of writings is opened into its pairs of rows,
    block of at most about ``block`` members by block, so the work is that of writing the result whatever class holds most of the rows. Rows with a null key, null and empty
    texts give no pairs.
    """
    rows = cut_lineage(forms(df, key, text).filter(F.col(key).isNotNull()))  # read three times; the texts only once
    mixed = rows.groupBy("form").agg(F.min("raw").alias("_low"), F.max("raw").alias("_high")).filter("_low <> _high").select("form")
    some = cut_lineage(rows.join(mixed, "form", "left_semi").select("form", "raw", F.col(key).alias("x")).distinct())
    writings = cut_lineage(some.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n")))
    slices = lambda n: F.ceil(F.col(n) / block).cast("int")
    pairs = _written_pairs(writings, block).select("a", "b", F.explode(F.sequence(F.lit(0), slices("na") - 1)).alias("ia"), "nb").select("a", "b", "ia", F.explode(F.sequence(F.lit(0), slices("nb") - 1)).alias("ib"))
    counted = split_join(some.drop("form"), writings.select("raw", "n"), ["raw"], writings.select("raw", "n"), hot_rows)
    members = counted.groupBy("raw", F.pmod(F.xxhash64("x"), slices("n")).cast("int").alias("i")).agg(F.collect_list("x").alias("xs"))  # about ``block`` a list
    one = lambda side: members.select(F.col("raw").alias(side), F.col("i").alias(f"i{side}"), F.col("xs").alias(f"x{side}"))
    met = pairs.join(one("a"), ["a", "ia"]).join(one("b"), ["b", "ib"])
    opened = met.select(F.explode("xa").alias("p"), "xb").select("p", F.explode("xb").alias("q")).filter("p <> q")
    return opened.select(F.least("p", "q").alias(f"{key}_a"), F.greatest("p", "q").alias(f"{key}_b"))
