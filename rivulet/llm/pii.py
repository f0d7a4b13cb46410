"""Personal data by weak supervision, in DataFrame functions only.

Fixed formats (email, ip, card, phone) are always reported.  Beyond them there are two families of candidates:
identifier-like tokens and values assigned to a sensitive word (kind secret), and runs of capitalised words (kind name).
Labelers vote on them: regular expressions on the candidate, gazetteers that it is looked up in, and its context.  The
counts of the vote patterns, a bounded table, go to the driver; expectation-maximisation estimates each labeler's reliability from
its agreement with the others, and the posteriors train a logistic span classifier on votes and shape.  Its decision is the
only one: a vote for a candidate, or a majority of them, does not report it, and one against does not clear it.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Possessive loops run without recursion, and the look-behind (or the end of the last match, \G) keeps a failed run
# from being tried again at each of its characters; both leave the matches as they are in the plain form.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = (*PATTERNS, "secret", "name")
TOKEN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{8,}+"
# what is assigned to a sensitive word, whatever it looks like
ASSIGNERS = ("passw", "pwd", "passphrase", "secret", "token")
ASSIGNED = r"(?i)\b(?:password|passwd|pwd|passphrase|secret|token)\b[\"']?(?:\s{1,2}is)?\s{0,2}[:=]?\s{0,2}[\"']?[^\s\"'.,;:!?=()<>]{4,}+"
ASSIGNED_VALUE = r"([^\s\"'.,;:!?=()<>]{4,})$"
# the look-behinds stand after what they look behind, so that they are only tried at a capital and at a dot
NAME = r"\p{Lu}(?<![\p{L}\p{N}].)\p{Ll}++(?:\.(?<=(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Dr|Prof)\.))?(?: \p{Lu}\p{Ll}++){1,3}+(?![\p{L}\p{N}])"
CAPITALS = r"\p{Lu}\p{Ll}++\.? \p{Lu}\p{Ll}"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
FOUND = "array<struct<start:bigint,end:bigint,hit:string,before:string,after:string>>"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


CHUNK = 64  # matches that are put together at a time: appending to one array of them all would copy it for each


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with positions in code points and up to 40 characters before and 12 after."""
    none = F.array().cast(FOUND)

    def found(p):
        gaps, hits = p["gaps"], p["hits"]

        def step(s, i):
            gap, hit = F.element_at(gaps, i), F.element_at(hits, i)
            begin = s["at"] + F.char_length(gap)
            end = begin + F.char_length(hit)
            one = F.struct(begin.alias("start"), end.alias("end"), hit.alias("hit"), F.right(gap, F.lit(40)).alias("before"), F.left(F.element_at(gaps, i + 1), F.lit(12)).alias("after"))
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

        def chunk(s, i):
            start = F.struct(s["at"].alias("at"), none.alias("out"))
            part = F.aggregate(F.sequence(i, F.least(i + CHUNK - 1, F.size(hits))), start, step)
            return let(part, lambda c: F.struct(c["at"].alias("at"), F.concat(s["out"], F.array(c["out"])).alias("out")))

        state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{FOUND}>").alias("out"))
        return F.when(F.size(hits) > 0, F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(hits), F.lit(CHUNK)), state, chunk)["out"])).otherwise(none)

    return let(F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("hits")), found)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the sum of the digits, every second from the right doubled and cast out by nines, ends in 0."""
    n = F.length(number)

    def add(total, i):
        d = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        n = F.length(digits(hit))
        return F.when((n >= 13) & (n <= 19), luhn(digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The spans of one fixed format; texts without the character that it needs are not searched."""
    found = F.filter(matches(text, PATTERNS[kind]), lambda m: valid(kind, m["hit"]))
    spans = F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    worth = text.rlike("[0-9]") if NEEDS[kind] is None else text.contains(NEEDS[kind])
    return F.when(worth, spans).otherwise(F.array().cast(SPAN))


def token_candidates(text: Column) -> Column:
    """Identifier-like tokens, and what is assigned to a sensitive word if it is none of them."""
    tokens = F.when(text.rlike("[0-9]"), matches(text, TOKEN)).otherwise(F.array().cast(FOUND))

    def value(m):
        hit = F.regexp_extract(m["hit"], ASSIGNED_VALUE, 1)
        head = F.substring(m["hit"], F.lit(1), F.char_length(m["hit"]) - F.char_length(hit))
        return F.struct((m["end"] - F.char_length(hit)).alias("start"), m["end"].alias("end"), hit.alias("hit"), head.alias("before"), m["after"].alias("after"))

    assigned = F.filter(F.transform(matches(text, ASSIGNED), value), lambda m: ~m["hit"].rlike(TOKEN) & (F.char_length(m["hit"]) > 0))
    lower = F.lower(text)
    worth = functools.reduce(lambda x, y: x | y, (lower.contains(w) for w in ASSIGNERS))
    return F.concat(tokens, F.when(worth, assigned).otherwise(F.array().cast(FOUND)))


def name_candidates(text: Column) -> Column:
    """Runs of two to four capitalised words, or a title and one at least."""
    return F.when(text.rlike(CAPITALS), matches(text, NAME)).otherwise(F.array().cast(FOUND))


# Fixed word lists of the labelers.
SENSITIVE = "password|passwd|pwd|passphrase|secret|token|api[ _-]?key|apikey|access[ _-]?key|private[ _-]?key|credential|auth|bearer|ssn|passport|iban|account|license[ _-]?key"
HARMLESS = "version|release|chapter|section|page|figure|table|isbn|issn|doi|http|https|www|copyright|license|article|id"
TERMS = "utf|utf-|sha|sha-|md|base|covid|covid-|iso|iso-|rfc|http|http/|ipv|win|windows|python|java|web|mp|h|x|amd|arm|vitamin|boeing|airbus|form|field|required|none|null|true|false|reset|manager|generator|based|ring|economy|exchange|protected|sharing"
GIVEN = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Nancy Daniel Lisa "
    "Matthew Betty Anthony Margaret Donald Sandra Steven Ashley Paul Kimberly Andrew Emily Joshua Donna Kenneth Michelle Kevin Carol Brian Amanda George Melissa Edward Deborah "
    "Hans Peter Klaus Wolfgang Jürgen Ursula Monika Petra Sabine Renate Jean Pierre Michel Philippe Nathalie Isabelle Sylvie Catherine Jacques Marie "
    "José Antonio Manuel Francisco Juan Carmen Josefa Dolores Pilar Teresa Anna Maria Giuseppe Giovanni Ahmed Mohammed Fatima Wei Yuki Olga Ivan Natalia"
)
PLACES = (
    "Street Avenue Road Square River Lake Mountain City County State States Kingdom Republic Island University College School Institute Hospital Church Museum Company Corporation "
    "License Licence Public General Foundation Software Committee Council Ministry Department Union Bank Party League Championship Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "January February March April June July August September October November December London Paris Berlin Madrid Rome Vienna New York Washington America Europe Africa Asia"
)
FUNCTION_WORDS = "The|A|An|Of|And|In|On|At|By|To|For|With|From|This|That|It|Is|Are|As|Be|Der|Die|Das|Und|Ein|Eine|Le|La|Les|Un|Une|De|Des|Du|Et|El|Los|Las|Del|Que|Y"
SECRET_LABELERS = ("known_format", "sensitive_word", "harmless_word", "assignment", "random_looking", "plain_word", "gazetteer_term")
NAME_LABELERS = ("gazetteer_given", "gazetteer_place", "title", "introduction", "sentence_start", "function_word", "deed")
LABELERS = {"secret": SECRET_LABELERS, "name": NAME_LABELERS}
SHAPES = 7


def listed(words: str) -> str:
    return rf"(?<![\p{{L}}\p{{N}}])(?:{words.replace(' ', '|')})(?![\p{{L}}\p{{N}}])"


def secret_votes(c: Column) -> list[Column]:
    """One vote per labeler for a token: 1 personal or secret, -1 harmless, 0 abstains."""
    hit, before, after = c["hit"], c["before"], c["after"]
    share = F.length(digits(hit)) / F.length(hit)
    return [
        F.when(hit.rlike(r"^(?:AKIA[0-9A-Z]{16}|(?=[0-9]*[a-f])(?:[0-9a-f]{2}){8,}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"), 1).otherwise(0),
        F.when(before.rlike(rf"(?i)\b(?:{SENSITIVE})\b[^A-Za-z0-9]{{0,6}}(?:is[^A-Za-z0-9]{{1,3}})?$"), 1).otherwise(0),
        F.when(before.rlike(rf"(?i)\b(?:{HARMLESS})\b[^A-Za-z0-9]{{0,6}}$"), -1).otherwise(0),
        F.when(before.rlike(r"[=:]\s{0,2}[\"']?$"), 1).when(before.rlike(r"[/?&#.]$") | after.rlike(r"^[/?&#]"), -1).otherwise(0),
        F.when((F.length(hit) >= 16) & (share >= 0.1) & hit.rlike("^[0-9]*[A-Za-z][0-9A-Za-z]*$"), 1).otherwise(0),
        F.when((F.length(hit) < 12) | hit.rlike(r"^(?:(?=.{0,15}$)[A-Za-z]+[_+/-]?[0-9]{0,4}|(?=.{0,15}$)[0-9]{1,4}[_+/-]?[A-Za-z]+|[0-9]+(?:[/-][0-9]+)*)$"), -1).otherwise(0),
        F.when(hit.rlike(rf"(?i)^(?:{TERMS})[0-9]*(?:[_/-][A-Za-z0-9]+)?$"), -1).otherwise(0),
    ]


def name_votes(c: Column) -> list[Column]:
    """One vote per labeler for capitalised words: 1 a person's name, -1 not, 0 abstains."""
    hit, before, after = c["hit"], c["before"], c["after"]
    return [
        F.when(hit.rlike(listed(GIVEN)), 1).otherwise(0),
        F.when(hit.rlike(listed(PLACES)), -1).otherwise(0),
        F.when(hit.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof)\b") | before.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.? $"), 1).otherwise(0),
        F.when(before.rlike(r"(?i)\b(?:name is|name|named|called|signed|contact|author|dear|regards|sincerely|patient|customer|employee|owner|heiße|m'appelle|me llamo)\s?[:,=]?\s{1,2}[\"']?$"), 1).otherwise(0),
        F.when(before.rlike(r"(?:^|[.!?;]\s{0,2}|\n)$"), -1).otherwise(0),
        F.when(hit.rlike(listed(FUNCTION_WORDS)) | hit.rlike(r"^(\p{L}++)(?: \1)+$"), -1).otherwise(0),
        F.when(after.rlike(r"^,? (?:said|says|lives|was born|wrote|called|<|\()"), 1).otherwise(0),
    ]


def shape(kind: str, c: Column) -> list[Column]:
    """Further indicators of the classifier, all 0 or 1."""
    n, d = F.length(c["hit"]), F.length(digits(c["hit"])) / F.length(c["hit"])
    if kind == "secret":
        found = (n >= 12, n >= 18, n >= 32, d >= 0.1, d >= 0.3, d >= 0.6, c["hit"].rlike("[A-Z]") & c["hit"].rlike("[a-z]"))
    else:
        spaces = n - F.length(F.replace(c["hit"], F.lit(" ")))
        found = (spaces >= 1, spaces >= 2, spaces >= 3, n >= 12, n >= 20, c["before"].rlike(r"\p{Ll},? $"), c["after"].rlike("^[.!?]"))
    return [x.cast("int") for x in found]


FAMILIES = {"secret": (token_candidates, secret_votes), "name": (name_candidates, name_votes)}


@dataclass
class SpanModel:
    """How often a cast vote of each labeler is right, and the classifier's weights on votes for, votes against and shape."""

    prior: float
    accuracy: list[float]
    weights: list[float]
    bias: float


RIGHT, WRONG = 8.0, 2.0  # what a labeler is taken to have got right and wrong before it is seen
PRIOR = 0.3  # the largest share of candidates that is taken to be personal before any vote


def estimate(votes_: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns: each labeler j, when it votes, is right with probability a_j, independently of the others.

    Starts from the sum of votes. A labeler may turn out to say nothing (a_j of one half), but not the opposite of what
    it means, and the prior is PRIOR at most; so the classes cannot change places and nothing is personal for want of votes. Returns the posteriors of the patterns, the prior and the a_j.
    """
    cast = votes_ != 0
    post = 1 / (1 + np.exp(0.5 - 1.5 * votes_.sum(axis=1)))
    prior, accuracy = PRIOR, np.full(votes_.shape[1], 0.8)
    for _ in range(rounds):
        right = np.where(votes_ > 0, post[:, None], 1 - post[:, None]) * cast
        accuracy = np.maximum(((right * counts[:, None]).sum(0) + RIGHT) / ((cast * counts[:, None]).sum(0) + RIGHT + WRONG), 0.5)
        prior = min(PRIOR, float((post @ counts + 1) / (counts.sum() + 3)))
        odds = np.log(prior / (1 - prior)) + (votes_ * np.log(accuracy / (1 - accuracy))).sum(1)
        post = 1 / (1 + np.exp(-odds))
    return post, prior, accuracy


def features(votes_: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    return np.concatenate([votes_ > 0, votes_ < 0, shapes > 0], axis=1).astype(float)


def train(votes_: np.ndarray, shapes: np.ndarray, counts: np.ndarray) -> SpanModel:
    """EM, then full-batch gradient descent on the cross-entropy with the posteriors, with a small penalty."""
    post, prior, accuracy = estimate(votes_, counts)
    x, share = features(votes_, shapes), counts / counts.sum()
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(3000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = (p - post) * share
        w -= 1.0 * (x.T @ g + 1e-4 * w)
        b -= 1.0 * g.sum()
    return SpanModel(prior, accuracy.tolist(), w.tolist(), float(b))


def fit(docs: DataFrame) -> dict[str, SpanModel]:
    """A model per family from the counts of vote and shape patterns over all candidates of all documents.

    The table that reaches the driver has a row per pattern, at most 2 * 3**7 * 2**7, however large docs is. A family
    without candidates has no model.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [f"v{i}" for i in range(len(SECRET_LABELERS))] + [f"s{i}" for i in range(SHAPES)]

    def tagged(kind: str) -> Column:
        return F.transform(FAMILIES[kind][0](text), lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("c")))

    found = docs.select(F.explode(F.concat(*map(tagged, FAMILIES))).alias("x")).select("x.kind", "x.c")
    per = {kind: [*votes(F.col("c")), *shape(kind, F.col("c"))] for kind, (_, votes) in FAMILIES.items()}
    cells = [F.when(F.col("kind") == "secret", s).otherwise(n).alias(name) for s, n, name in zip(per["secret"], per["name"], names, strict=True)]
    rows = found.select("kind", *cells).groupBy("kind", *names).count().orderBy("kind", *names).collect()
    models = {}
    for kind in FAMILIES:
        mine = [r for r in rows if r["kind"] == kind]
        if mine:
            table = np.array([list(r)[1:-1] for r in mine], float)
            models[kind] = train(table[:, :-SHAPES], table[:, -SHAPES:], np.array([r["count"] for r in mine], float))
    return models


def score(kind: str, model: SpanModel, c: Column) -> Column:
    votes = FAMILIES[kind][1](c)
    inputs = [(v > 0).cast("int") for v in votes] + [(v < 0).cast("int") for v in votes] + shape(kind, c)
    total = F.lit(model.bias)
    for x, w in zip(inputs, model.weights, strict=True):
        total = total + x * F.lit(w)
    return total


def added_spans(text: Column, models: dict[str, SpanModel] | None) -> Column:
    """Candidates that their family's classifier accepts (probability above one half), as spans of the family's kind."""

    def of(kind: str) -> Column:
        chosen = F.filter(FAMILIES[kind][0](text), lambda c: score(kind, models[kind], c) > 0)
        return F.transform(chosen, lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))

    return F.concat(F.array().cast(SPAN), *(of(kind) for kind in models or {}))


def with_spans(docs: DataFrame, model: dict[str, SpanModel] | None) -> DataFrame:
    """docs with __base (spans of the fixed formats, by kind and start) and __spans (those and the added ones)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumns({f"__{k}": base_spans(text, k) for k in PATTERNS} | {"__more": added_spans(text, model)})
    base = F.concat(*(F.col(f"__{k}") for k in PATTERNS))
    out = out.withColumn("__base", base)
    apart = F.filter("__more", lambda m: ~F.exists("__base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return out.withColumn("__spans", F.concat("__base", apart))


def find_pii(docs: DataFrame, model: dict[str, SpanModel] | None) -> DataFrame:
    """doc_id, spans (array of kind, start, end; code points, end exclusive), base (those of the fixed formats).

    Null text counts as empty; repeated rows each give a row; an empty table gives none; other columns are ignored.
    """
    return with_spans(docs.select("doc_id", "text"), model).select("doc_id", F.col("__spans").alias("spans"), F.col("__base").alias("base"))


def redact(docs: DataFrame, model: dict[str, SpanModel] | None) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets, and n_chars (if there) counted anew for changed texts.

    Overlapping spans become one, under the kind that starts first. Null texts stay null.
    """
    spans = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s, p):
        end = -p["back"]
        piece = F.array(F.substring(F.col("text"), (s["at"] + 1).cast("int"), (p["start"] - s["at"]).cast("int")), F.concat(F.lit("<"), F.upper(p["kind"]), F.lit(">")))
        fresh = p["start"] >= s["at"]
        return F.struct(F.greatest(s["at"], end).alias("at"), F.when(fresh, F.concat(s["out"], piece)).otherwise(s["out"]).alias("out"))

    done = F.aggregate(spans, state, step)
    text = F.array_join(F.concat(done["out"], F.array(F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.char_length("text")))), "")
    changed = F.when(F.size("__spans") > 0, text).otherwise(F.col("text"))
    out = with_spans(docs, model).withColumn("__new", changed)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__new").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.size("__spans") > 0, F.char_length("__new").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))
        else:
            columns.append(F.col(c))
    return out.select(*columns)


def op10_query(docs: DataFrame) -> DataFrame:
    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_pii(docs, fit(docs)).select("doc_id", *(count(k) for k in PATTERNS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
