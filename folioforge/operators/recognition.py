"""Label and value recognition, and the columns that a corpus has in common.

A text is read as a whole where it is, in an Arrow function (``functions/pairs.py``), so no line is shuffled. Only pairs are exploded.
With detectors other than the usual ones, which are columns, it is Catalyst alone: the lines of a document are an array of its row, and
pairing looks at neighbours by index; interpreted, that takes several times as long. Both give the same.

A line is a pair by itself (``Label: value``, or a label, two spaces or more, and a value), a label alone, a value (what no label
can be), or a break. With ``K`` for "is a known label" the pairing has a closed form, as an overridden line is never shaped
like a label, and a label that was taken as a value is not known and so takes none itself:

* a label whose line ends in a colon makes the next line its value, even one with a wide gap in it;
* a label over a value line takes it;
* a known label over a label that is not known takes that as its value.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.detectors import DETECTORS, Detector, classify
from ..functions.pairs import MAX_VALUE, STOPWORDS, Pair, normal, plain_kinds, reader
from ..functions.text import is_blank, normalize_label, split_lines, strip

MAX_FIELDS, MIN_SUPPORT = 25, 0.5
BOILERPLATE_SHARE, BOILERPLATE_DOCS = 0.9, 5
#: Texts that are Python strings at a time.
_SLICE = 256

_SPACES = r"[\s\x1c-\x1f]"
_LABEL = r"([A-Za-z][A-Za-z0-9 " + r"/&'().#-]{1,40}?)"
_COLON = rf"(?U)^{_SPACES}*{_LABEL}{_SPACES}*:{_SPACES}*(.+?){_SPACES}*$"
_COLUMN = rf"(?U)^{_SPACES}*{_LABEL}{_SPACES}{{2,}}([^\s\x1c-\x1f].*?){_SPACES}*$"
_ALONE = rf"(?U)^{_SPACES}*{_LABEL}{_SPACES}*:?{_SPACES}*$"


def _once(struct: Column) -> Column:
    """Evaluates a struct once per row: as a generator, no later projection or filter is merged into it."""
    return F.inline(F.array(struct))


def _classes(line: Column, registry: Sequence[Detector]) -> Column:
    """What a line, without white space at its end, is: c (colon pair), g (gap pair), l (label), v (value), b (break); with its label and value."""
    return F.struct(
        line.alias("line"),
        F.when(line == "", "b").when(F.contains(line, F.lit(":")) & line.rlike(_COLON), "c").when(line.rlike(_COLUMN), "g")
        .when(line.rlike(_ALONE) & (classify(strip(line), tuple(registry)) == "text"), "l").otherwise("v").alias("kind"),
    )


def _classified(docs: DataFrame, text: str = "text", registry: Sequence[Detector] = DETECTORS) -> DataFrame:
    """The documents with their lines, classed: what doesn't depend on which labels are known."""
    rows = [F.col(f"`{c}`") for c in docs.columns]
    lines = docs.select(*rows, _once(F.struct(F.transform(split_lines(F.coalesce(F.col(text), F.lit(""))), lambda x: _classes(x, registry)).alias("__lines"))))

    def full(x: Column) -> Column:
        label = F.when(x.kind == "c", F.regexp_extract(x.line, _COLON, 1)).when(x.kind == "g", F.regexp_extract(x.line, _COLUMN, 1)).when(x.kind == "l", F.regexp_extract(x.line, _ALONE, 1))
        value = F.when(x.kind == "c", F.regexp_extract(x.line, _COLON, 2)).when(x.kind == "g", F.regexp_extract(x.line, _COLUMN, 2)).otherwise(strip(x.line))
        return F.struct(x.kind.alias("kind"), normalize_label(label).alias("label"), value.alias("value"), strip(x.line).alias("line"), x.line.endswith(":").alias("opens"))

    return lines.select(*rows, _once(F.struct(F.transform("__lines", full).alias("__lines"))))


def with_pairs(docs: DataFrame, text: str = "text", known: Sequence[str] = (), column: str = "pairs", max_value: int = MAX_VALUE, registry: Sequence[Detector] = DETECTORS) -> DataFrame:
    """The documents with an array of structs line_no, label and value: for each label its first value."""
    if tuple(registry) != DETECTORS:
        return _paired(_classified(docs, text, registry), known, column, max_value)
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != column], _pairs(known, max_value)(F.col(f"`{text}`")).alias(column))


def _read(texts: pa.Array, read: Callable[[str | None], tuple[list[Pair], bool]]) -> Iterator[tuple[list[Pair], bool]]:
    for k in range(0, len(texts), _SLICE):
        yield from map(read, texts.slice(k, _SLICE).to_pylist())


def _arrow(f: Callable[[pa.Array], pa.Array], kind: str):
    f.__annotations__ = {"texts": pa.Array, "return": pa.Array}  # as types, not as their names
    return F.arrow_udf(f, kind)


def _pairs(known: Sequence[str], max_value: int) -> Callable[[Column], Column]:
    known = list(known)

    def pairs(texts: pa.Array) -> pa.Array:
        ends, found = [0], []
        for own, _ in _read(texts, reader(known, max_value)):
            found += own
            ends.append(len(found))
        line_no, label, value = zip(*found) if found else ((), (), ())
        items = pa.StructArray.from_arrays([pa.array(line_no, pa.int32()), pa.array(label, pa.string()), pa.array(value, pa.string())], ["line_no", "label", "value"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    # else the filter that goes with a generator would call it a second time, and below a repartition
    return _arrow(pairs, "array<struct<line_no: int, label: string, value: string>>").asNondeterministic()


def _values(labels: Sequence[str]) -> Callable[[Column], Column]:
    """The values of these labels, which are known, in their order; empty where a text doesn't have one."""
    labels = list(labels)
    keys = [normal(x) for x in labels]

    def values(texts: pa.Array) -> pa.Array:
        found = []
        for own, _ in _read(texts, reader(labels)):
            by = {label: value for _, label, value in own}
            found += [by.get(k, "") for k in keys]
        ends = range(0, len(found) + 1, len(keys))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.string()))

    return _arrow(values, "array<string>")


def _paired(lines: DataFrame, known: Sequence[str] = (), column: str = "pairs", max_value: int = MAX_VALUE) -> DataFrame:
    names = [c for c in lines.columns if c != "__lines"]
    rows = [F.col(f"`{c}`") for c in names]
    known_keys = F.array(*[normalize_label(F.lit(k)) for k in known]) if known else F.array().cast("array<string>")
    lines = lines.select(*rows, "__lines", _once(F.struct(known_keys.alias("__known"))))
    lines = lines.select(*rows, _once(F.struct(F.transform("__lines", lambda x: F.struct(x["kind"].alias("kind"), x["label"].alias("label"), x["value"].alias("value"), x["line"].alias("line"), x["opens"].alias("opens"), ((x["kind"] == "l") & F.array_contains(F.col("__known"), F.coalesce(x["label"], F.lit("")))).alias("known"))).alias("__lines"))))

    at = lambda i: F.get(F.col("__lines"), i)
    no = lambda c: F.coalesce(c, F.lit(False))

    def taken(x: Column, i: Column) -> Column:
        """Line i is a gap pair that the label above it, with its colon, makes a value."""
        above = at(i - 1)
        return (x["kind"] == "g") & (i > 0) & no((above["kind"] == "l") & above["opens"])

    def pair(x: Column, i: Column) -> Column:
        above, below = at(i - 1), at(i + 1)
        inline = x["kind"].isin("c", "g") & ~taken(x, i)
        consumed = (i > 0) & (x["kind"] == "l") & ~x["known"] & no((above["kind"] == "l") & above["known"])
        is_value = no((below["kind"] == "v") | ((below["kind"] == "g") & x["opens"]))
        stacked = (x["kind"] == "l") & ~consumed & (is_value | (x["known"] & no((below["kind"] == "l") & ~below["known"])))
        value = F.when(inline, x["value"]).when(stacked, below["line"])
        return F.struct(i.alias("line_no"), x["label"].alias("label"), strip(value).alias("value"))

    def holds(p: Column) -> Column:
        good_key = (F.length(p["label"]) >= 2) & ~p["label"].isin(*STOPWORDS) & ~p["label"].rlike(r"(?U)^\d+$")
        return p["value"].isNotNull() & (p["value"] != "") & (F.length(p["value"]) <= max_value) & good_key

    found = lines.select(*rows, _once(F.struct(F.filter(F.transform("__lines", pair), holds).alias("__pairs"))))
    keyed = found.select(*rows, "__pairs", _once(F.struct(F.transform("__pairs", lambda p: p["label"]).alias("__keys"))))
    first = F.filter("__pairs", lambda p, i: F.array_position(F.col("__keys"), p["label"]) == i + 1)
    return keyed.select(*[c for n, c in zip(names, rows) if n != column], first.alias(column))


def label_values(docs: DataFrame, key: str = "ordinal", text: str = "text", known: Sequence[str] = ()) -> DataFrame:
    """The pairs as a table: key, line_no, label, value."""
    return with_pairs(docs.select(key, text), text, known).select(key, F.inline("pairs"))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, text).filter(~is_blank(text))


def _counted(docs: DataFrame, key: str, text: str, known: Sequence[str] | None) -> DataFrame:
    """What each batch of texts says of its labels, in rows of these kinds (``what``):

    * ``documents``: ``n`` texts were read;
    * ``label``: ``n`` of them state a label plainly;
    * ``kind``: of a label, ``n`` values have a kind (null: Catalyst has to tell), the first at a key and line;
    * ``most``: one value is more than half, ``n``, of the ``of`` values that a label has in the batch;
    * ``text``: what this text has depends on which labels are known.

    With ``known`` given only the second and last kind are left out."""
    at = docs.schema[key].dataType
    schema = T.StructType([T.StructField(n, t) for n, t in (("what", T.StringType()), ("label", T.StringType()), ("kind", T.StringType()), ("value", T.StringType()), ("n", T.LongType()), ("of", T.LongType()), ("line_no", T.IntegerType()), ("key", at), ("text", T.StringType()))])
    given, names = known is not None, list(known or ())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, kind_of = reader(names), plain_kinds()
        for b in batches:
            if not b.num_rows:
                continue
            keys, texts = b.column(0), b.column(1)
            # the places of the keys in their order, so that they are compared as numbers; of types that Arrow orders in another way or not
            # at all, every value is a row
            place = [0] * len(keys)
            ordered = not pa.types.is_floating(keys.type) and not pa.types.is_nested(keys.type)
            for k, i in enumerate(pc.array_sort_indices(keys, null_placement="at_start").to_pylist() if ordered else ()):
                place[i] = k
            labels: Counter[str] = Counter()
            kinds: dict[tuple[str, str], list] = {}
            unsure: list[tuple[str, str, int, int]] = []
            values: defaultdict[str, list[str]] = defaultdict(list)
            later: list[int] = []
            for i, (own, depends) in enumerate(_read(texts, read)):
                if not given:
                    labels.update(label for _, label, _ in own)
                    if depends:
                        later.append(i)
                        continue
                for line_no, label, value in own:
                    values[label].append(value)
                    if not ordered or (kind := kind_of(value)) is None:
                        unsure.append((label, value, line_no, i))
                    elif (known_kind := kinds.get((label, kind))) is None:
                        kinds[label, kind] = [1, place[i], line_no, value, i]
                    else:
                        known_kind[0] += 1
                        if place[i] < known_kind[1]:
                            known_kind[1:] = place[i], line_no, value, i
            rows = [("documents", None, None, None, len(keys), None, None, None, None)]
            rows += [("label", x, None, None, n, None, None, None, None) for x, n in labels.items()]
            rows += [("kind", x, kind, value, n, None, line_no, i, None) for (x, kind), (n, _, line_no, value, i) in kinds.items()]
            rows += [("kind", x, None, value, 1, None, line_no, i, None) for x, value, line_no, i in unsure]
            for x, own in values.items():
                (value, n), of = Counter(own).most_common(1)[0], len(own)
                if 2 * n > of:
                    rows.append(("most", x, None, value, n, of, None, None, None))
            rows += [("text", None, None, None, 1, None, None, i, i) for i in later]
            for k in range(0, len(rows), 10_000):
                *plain, key_at, text_at = zip(*rows[k : k + 10_000])
                kept = [pa.array(x, t) for x, t in zip(plain, (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*kept, keys.take(pa.array(key_at, pa.int64())), texts.take(pa.array(text_at, pa.int64()))], names=schema.names)

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(count, schema)


def _shared(counted: DataFrame, total: int, min_support: float) -> list[str]:
    counts = counted.filter("what = 'label'").groupBy("label").agg(F.sum("n").alias("n"))
    return sorted(r.label for r in counts.filter(F.col("n") / F.lit(float(max(total, 1))) >= min_support).select("label").collect())


def _total(counted: DataFrame) -> int:
    return counted.filter("what = 'documents'").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]


def common_labels(docs: DataFrame, key: str = "ordinal", text: str = "text", min_support: float = MIN_SUPPORT) -> list[str]:
    """Labels that this share of the documents with text states plainly. As a document has few labels, these are at most its
    number of labels over the share."""
    counted = _counted(_texts(docs, key, text), key, text, None).filter("what in ('documents', 'label')").persist(StorageLevel.DISK_ONLY)
    try:
        return _shared(counted, _total(counted), min_support)
    finally:
        counted.unpersist()


def infer_schema(docs: DataFrame, key: str = "ordinal", text: str = "text", min_support: float = MIN_SUPPORT, max_fields: int = MAX_FIELDS, known: Sequence[str] | None = None, sample: int | None = None) -> DataFrame:
    """The columns that a corpus proposes: label, support, ratio, kind, example; most supported first, on ties the first seen.

    ``sample`` looks at so many documents only, the first by key: a quick proposal, as a person waits for it. The key orders the
    documents. Texts are read once; what their batches say of their labels is kept on the executors' disks, with the texts whose pairs
    depend on which labels are known, and those are read again. No value is shuffled, only labels with their kinds, of each batch.
    Only the at most ``max_fields`` rows of the result reach the driver, and before them the labels of enough support, to see whether one
    value is most of theirs. Where their batches alone don't tell that, the texts are read another time."""
    docs = _texts(docs if sample is None else docs.select(key, text).orderBy(key).limit(sample), key, text)
    counted = _counted(docs, key, text, known).persist(StorageLevel.DISK_ONLY)
    again = None
    try:
        total = _total(counted)
        every = counted
        if known is None:
            known = _shared(counted, total, min_support)
            again = _counted(counted.filter("what = 'text'").select(F.col("key").alias(key), F.col("text").alias(text)), key, text, known).persist(StorageLevel.DISK_ONLY)
            every = counted.unionByName(again)
        told = every.filter("what = 'kind'").withColumn("kind", F.coalesce("kind", classify("value")))
        kinds = told.groupBy("label", "kind").agg(F.sum("n").alias("n"), F.min(F.struct("key", "line_no", "value")).alias("first"))
        most = every.filter("what = 'most'").groupBy("label", "value").agg(F.sum("n").alias("n"), F.sum("of").alias("of"))
        share = F.col("support") / F.lit(float(max(total, 1)))
        seen = kinds.groupBy("label").agg(F.sum("n").alias("support"), F.min("first").alias("first")).filter(share >= min_support)
        # in batches where it isn't more than half, a value is at most half
        held = most.join(seen.filter(F.col("support") >= BOILERPLATE_DOCS).select("label", "support"), "label").filter((F.col("n") + (F.col("support") - F.col("of")) / 2) / F.col("support") >= BOILERPLATE_SHARE)
        found = held.select("label", "value", "n", "support").collect()
        boilerplate = [r.label for r in found if r.n / r.support >= BOILERPLATE_SHARE]
        if unsure := {(r.label, r.value): r.support for r in found if r.label not in boilerplate}:
            pairs = label_values(docs, key, text, known).filter(F.col("label").isin([x for x, _ in unsure]) & F.col("value").isin([x for _, x in unsure]))
            boilerplate += [r.label for r in pairs.groupBy("label", "value").count().collect() if (r.label, r.value) in unsure and r["count"] / unsure[r.label, r.value] >= BOILERPLATE_SHARE]
        best = kinds.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "first"))).filter("place = 1")
        real = seen.filter(~F.col("label").isin(boilerplate)) if boilerplate else seen
        ranked = real.join(best.select("label", "kind", F.col("first.value").alias("example")), "label").orderBy(F.desc("support"), "first").limit(max_fields)
        rows = ranked.select("label", "support", F.bround(share, 3).alias("ratio"), "kind", "example").collect()
    finally:
        counted.unpersist()
        if again is not None:
            again.unpersist()
    return docs.sparkSession.createDataFrame(rows, "label string, support bigint, ratio double, kind string, example string").coalesce(1)


def extract_fields(docs: DataFrame, labels: Sequence[str], text: str = "text") -> DataFrame:
    """The documents with a column per label, empty where a document doesn't have it. A label named like a column of the
    documents takes its place."""
    names = docs.columns
    wanted = list(dict.fromkeys(labels))
    if not wanted:
        return docs
    rows = [F.col(f"`{c}`") for c in names if c not in wanted]
    found = docs.select(*rows, _values(wanted)(F.col(f"`{text}`")).alias("__values"))
    return found.select(*rows, *[F.get("__values", F.lit(k)).alias(x) for k, x in enumerate(wanted)])
