"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become templates: numbers, names and units turn into typed placeholders, everything else into lower-case words.
Every window of seed template words of the benchmark is hash-joined with every window of the documents, so a run of seed
words is met wherever it stands.  Where a window meets, document and item are laid side by side, template
words are compared one by one, and a placeholder only counts if its item value always stands for the same document
value.  So a question with other numbers or names in it is found, and chance windows are not.  Windows of placeholders
are met like others; what only they meet must share plain words with the item, or a list of numbers would be a leak.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import written

# Unit words that count as one placeholder.
UNITS = (
    "mm cm km kg mg ml lb lbs oz ft mph kph kmh meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard yards gram grams kilogram kilograms pound pounds "
    "ounce ounces ton tons liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees"
).split()
MARK = "\u0002"  # stands before a name
NAME = r"(?<=[\p{Ll}\p{N},;:)] )\p{Lu}\p{Ll}+(?!\p{L})"
WORD = MARK + r"?[\p{L}\p{N}]++(?:[.,][0-9]++)*+"


def template_words(text: Column) -> Column:
    """Words, lower-case; names (capitalised inside a sentence) keep a mark, numbers their decimals."""
    clean = F.translate(F.coalesce(text.cast("string"), F.lit("")), MARK, " ")
    return F.regexp_extract_all(F.lower(F.regexp_replace(clean, NAME, MARK + "$0")), F.lit(WORD), 0)


def canonical(word: Column) -> Column:
    return (
        F.when(word.startswith(MARK), F.lit("<name>"))
        .when(word.rlike("^[0-9]"), F.when(word.rlike("^[0-9][0-9.,]*$"), F.lit("<num>")).otherwise(word))
        .when(word.isin(UNITS), F.lit("<unit>"))
        .otherwise(word)
    )


def is_slot(word: Column) -> Column:
    return word.isin("<name>", "<num>", "<unit>")


def windows(words: Column, seed: int) -> Column:
    """(place, hash) of every window of seed template words."""
    size = F.size(words)
    places = F.when(size >= seed, F.sequence(F.lit(1), size - seed + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(F.slice(words, i, F.lit(seed))).alias("hash")))


def plain_words(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~is_slot(w)))


def leaks(docs: DataFrame, benchmark: DataFrame, seed: int = 5, min_coverage: float = 0.5, min_run: int = 13, max_broadcast_windows: int = 2_000_000) -> DataFrame:
    """One row per document and item that leaks into it.

    doc_id, item_id, n_words (template words of the item), n_matched (those met in runs of three at least, in place),
    coverage, longest_run, n_slots_changed (placeholders whose value differs). A pair is reported if coverage reaches
    min_coverage or a run has min_run words. A pair that no window with three plain words meets must besides match three
    plain words of the item (all, if it has fewer; an item of placeholders only, its own values).

    Null and empty texts and items leak nothing; rows with null ids are not reported; repeated rows count once; empty
    tables give no rows; other columns are ignored. An item of fewer than seed words is too short to be told.

    Every run of seed matching template words is met, so a pair may be missed only if all its matching runs are shorter.
    Against every shift of every pair, on copies with 5 to 25 % of their words edited: 151 of the 159 pairs that the rule
    names are found: 135 of 137 with a coverage of 0.7 or more, 16 of 22 below.

    The benchmark's windows are counted, and broadcast up to max_broadcast_windows; beyond, the join shuffles. The words
    of a document that meets any are taken once and written; a hit carries only the words that lie against its item.
    """
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), template_words(F.col("text")).alias("raw")).distinct()
    items = written(items.withColumn("item", F.transform("raw", canonical)), "items")
    rich = plain_words(F.slice("item", F.col("w.place"), F.lit(seed))) >= min(3, seed)
    index = written(items.select("item_id", "item", F.explode(windows(F.col("item"), seed)).alias("w")).select("item_id", F.col("w.place").alias("at"), F.col("w.hash").alias("hash"), rich.alias("rich")), "windows")
    probes = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(template_words(F.col("text")), canonical).alias("t"))
    probes = probes.select("doc_id", F.explode(windows(F.col("t"), seed)).alias("w")).select("doc_id", F.col("w.place").alias("place"), F.col("w.hash").alias("hash"))
    small = index.count() <= max_broadcast_windows
    met = probes.join(F.broadcast(index) if small else index, "hash")
    shifts = met.groupBy("doc_id", "item_id", (F.col("place") - F.col("at")).alias("shift")).agg(F.max("rich").alias("rich"))
    lengths = items.select("item_id", F.size("item").alias("size"))
    hits = written(shifts.join(F.broadcast(lengths) if small else lengths, "item_id"), "hits")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    words = written(texts.select("doc_id", template_words(F.col("text")).alias("words")), "words")
    # item word i (from 1) lies against document word i + shift; what is before or after the document is null
    first = F.greatest(F.col("shift"), F.lit(0))
    some = F.slice("words", first + 1, F.greatest(F.least(F.size("words"), F.col("shift") + F.col("size")) - first, F.lit(0)))
    part = F.concat(F.array_repeat(F.lit(None).cast("string"), first - F.col("shift")), some)
    laid = hits.join(words, "doc_id").select("doc_id", "item_id", "rich", F.concat(part, F.array_repeat(F.lit(None).cast("string"), F.col("size") - F.size(part))).alias("part"))
    side = laid.join(F.broadcast(items) if small else items, "item_id")
    side = side.withColumn("template", F.transform("part", canonical))

    def met_at(i):
        word = F.element_at("item", i)
        kind = F.coalesce(word == F.element_at("template", i), F.lit(False))
        first = F.array_position("raw", F.element_at("raw", i)).cast("int")
        steady = F.coalesce(F.element_at("part", i) == F.element_at("part", first), F.lit(False))
        return kind & (~is_slot(word) | steady)

    side = side.withColumn("same", F.transform(F.sequence(F.lit(1), F.size("item")), met_at))
    state = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    run = F.aggregate("same", state, lambda s, x: F.struct(F.when(x, s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["best"], F.when(x, s["now"] + 1).otherwise(0)).alias("best")))["best"]

    def at(i):
        return F.coalesce(F.try_element_at("same", i), F.lit(False))

    # places in runs of three at least; 0 does not index, so the ends are shifted by a leading false
    def in_run(i):
        j = i + 2
        return at(j) & ((at(j - 1) & (at(F.greatest(j - 2, F.lit(1))) & (j > 2) | at(j + 1))) | (at(j + 1) & at(j + 2)))

    side = side.withColumn("run", run).withColumn("same", F.concat(F.array(F.lit(False), F.lit(False)), F.col("same")))
    places = F.transform(F.filter(F.sequence(F.lit(1), F.size("item")), in_run), lambda i: F.struct(i.alias("at"), (~is_slot(F.element_at("item", i))).alias("plain")))
    changed = F.size(F.filter(F.sequence(F.lit(1), F.size("item")), lambda i: at(i + 2) & is_slot(F.element_at("item", i)) & (F.element_at("part", i) != F.element_at("raw", i))))
    found = side.select("doc_id", "item_id", F.size("item").cast("long").alias("n_words"), plain_words(F.col("item")).alias("n_plain"), "rich", places.alias("places"), "run", changed.alias("changed"))
    per = found.withColumn("p", F.explode_outer("places")).groupBy("doc_id", "item_id", "n_words", "n_plain")
    own = F.max((F.col("changed") == 0) & (F.col("run") >= seed))
    plain = F.countDistinct(F.when(F.col("p.plain"), F.col("p.at")))
    out = per.agg(F.countDistinct("p.at").alias("n_matched"), F.max("run").cast("long").alias("longest_run"), F.max("changed").cast("long").alias("n_slots_changed"), F.max("rich").alias("rich"), own.alias("own"), plain.alias("plain"))
    out = out.where(F.col("rich") | F.when(F.col("n_plain") > 0, F.col("plain") >= F.least(F.col("n_plain"), F.lit(3))).otherwise(F.col("own")))
    out = out.withColumn("coverage", F.col("n_matched") / F.col("n_words"))
    return out.where((F.col("coverage") >= min_coverage) | (F.col("longest_run") >= min_run)).select("doc_id", "item_id", "n_words", "n_matched", "coverage", "longest_run", "n_slots_changed")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose documents hold no leak; rows without doc_id are kept."""
    bad = written(leaks(docs, benchmark).select("doc_id").distinct(), "leaking")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)


def op7_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return leaks(docs, benchmark)


_UNIT_LIST = ", ".join(f"'{u}'" for u in UNITS)
_MARKED = r"regexp_replace({0}, '([\p{{Ll}}\p{{N}},;:)] )(\p{{Lu}}\p{{Ll}}+)([^\p{{L}}]|$)', '\1' || chr(2) || '\2\3', 'g')"
# RE2 has no look-behind, and what a match takes cannot begin the next one: two passes mark names that follow each other
_WORDS = "regexp_extract_all(lower(" + _MARKED.format(_MARKED.format("replace(coalesce(text, ''), chr(2), ' ')")) + r"), '\x02?[\p{L}\p{N}]+(?:[.,][0-9]+)*')"
_TEMPLATE = rf"list_transform(w, lambda x: CASE WHEN starts_with(x, chr(2)) THEN '<name>' WHEN regexp_matches(x, '^[0-9][0-9.,]*$') THEN '<num>' WHEN x IN ({_UNIT_LIST}) THEN '<unit>' ELSE x END)"
_SLOT = "('<name>', '<num>', '<unit>')"
OP7_SQL = rf"""
WITH i0 AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item_id, w AS raw, {_TEMPLATE} AS item FROM i0),
d0 AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT doc_id, w, {_TEMPLATE} AS t FROM d0),
iw AS (SELECT item_id, p, item[p:p + 4] AS k FROM i, unnest(range(1, len(item) - 3)) AS u(p)),
dw AS (SELECT doc_id, p, t[p:p + 4] AS k FROM d, unnest(range(1, len(t) - 3)) AS u(p)),
h AS (SELECT doc_id, item_id, dw.p - iw.p AS shift, bool_or(len(list_filter(iw.k, lambda x: x NOT IN {_SLOT})) >= 3) AS rich FROM dw JOIN iw ON dw.k = iw.k GROUP BY ALL),
s AS (SELECT h.doc_id, h.item_id, h.rich, i.raw, i.item, list_transform(range(1, len(item) + 1), lambda j: CASE WHEN j + shift >= 1 THEN d.w[j + shift] END) AS part,
  list_transform(range(1, len(item) + 1), lambda j: CASE WHEN j + shift >= 1 THEN d.t[j + shift] END) AS template FROM h JOIN d USING (doc_id) JOIN i USING (item_id)),
m AS (SELECT doc_id, item_id, rich, raw, item, part, list_transform(range(1, len(item) + 1), lambda j: coalesce(item[j] = template[j], false)
  AND (item[j] NOT IN {_SLOT} OR coalesce(part[j] = part[list_position(raw, raw[j])], false))) AS same FROM s),
r AS (SELECT doc_id, item_id, rich, item, len(item) AS n_words, len(list_filter(item, lambda x: x NOT IN {_SLOT})) AS n_plain, list_filter(range(1, len(item) + 1), lambda j: same[j] AND (
    coalesce(j > 1 AND same[j - 1] AND (j > 2 AND same[j - 2] OR coalesce(same[j + 1], false)), false) OR coalesce(same[j + 1] AND same[j + 2], false))) AS places,
  coalesce(list_max(list_transform(regexp_extract_all(array_to_string(list_transform(same, lambda x: CASE WHEN x THEN '1' ELSE '0' END), ''), '1+'), lambda x: len(x))), 0) AS run,
  len(list_filter(range(1, len(item) + 1), lambda j: same[j] AND item[j] IN {_SLOT} AND part[j] <> raw[j])) AS changed FROM m),
p AS (SELECT doc_id, item_id, count(DISTINCT x) AS n, count(DISTINCT CASE WHEN item[x] NOT IN {_SLOT} THEN x END) AS plain FROM r, unnest(places) AS u(x) GROUP BY 1, 2),
g AS (SELECT doc_id, item_id, n_words, n_plain, bool_or(rich) AS rich, bool_or(changed = 0 AND run >= 5) AS own, max(run) AS longest_run, max(changed) AS n_slots_changed FROM r GROUP BY doc_id, item_id, n_words, n_plain)
SELECT g.doc_id, g.item_id, g.n_words, coalesce(p.n, 0) AS n_matched, coalesce(p.n, 0) / g.n_words AS coverage, g.longest_run, g.n_slots_changed
FROM g LEFT JOIN p USING (doc_id, item_id) WHERE (coalesce(p.n, 0) / g.n_words >= 0.5 OR g.longest_run >= 13)
  AND (g.rich OR CASE WHEN g.n_plain > 0 THEN coalesce(p.plain, 0) >= least(g.n_plain, 3) ELSE g.own END)
"""
