"""Personal data by weak supervision, in DataFrame functions only.

Candidate spans come from strict patterns (the base kinds) and looser ones.
Labelers vote on each candidate: pattern and check digits, gazetteers of cue
words and prefixes, and the characters around.  Expectation-maximisation on the
table of vote patterns (at most 3**4 per kind, whatever the corpus) estimates how
reliable each labeler is; its posteriors then train a naive Bayes classifier on
span features, which decides the looser candidates.  Base spans always stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

# Each pattern finds what its plain form finds, without backtracking over long runs:
# a match may begin inside a run only where the last one ended (\G).
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# chains of digits with single spaces or hyphens between; only those of 14 to 19 digits
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_EMAIL_HIDDEN = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)++"
_PHONE_LOCAL = r"(?<![0-9+.-])(?<!\+[0-9]{1,3} )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-]*[0-9])"
_ID_NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: (kind, pattern, what a text must contain), base kinds first; the order breaks ties of starts.
KINDS = (
    ("email", _EMAIL, "@"),
    ("ip", _IP, "."),
    ("card", _CARD, ""),
    ("phone", _PHONE, "+"),
    ("email_hidden", _EMAIL_HIDDEN, "at"),
    ("phone_local", _PHONE_LOCAL, ""),
    ("id_number", _ID_NUMBER, "-"),
)
BASE = 4
CUES = r"(?i)(?:e-?mail|mail|contact|tel|phone|call|fax|mobile|card|visa|credit|pay|ip|server|host|address|ssn|social|id)[^A-Za-z]{0,3}$"
LABELERS = 4
EM_STEPS = 25
_AROUND = 16
#: Matches whose places are summed up one by one, and code points of the pieces that a long text is cut into.
_BLOCK = 128
_PIECE = 256


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(value, "[ -]", ""), "(?<=.)(?=.)"))
    total = F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.when(d.cast("int") > 4, 1).otherwise(0))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _valid(kind: str, value: Column) -> Column:
    """The check that a match of the kind's pattern must pass."""
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where a lambda inside the body uses it."""
    return F.transform(F.array(value), body)[0]


def _pieces(text: Column) -> Column:
    """A text in pieces of _PIECE code points: a place far inside is found without counting from the beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def _between(pieces: Column, begin: Column, end: Column) -> Column:
    """Code points begin to end, exclusive, of the text."""
    first = F.floor(begin / _PIECE).cast("int")
    some = F.slice(pieces, first + 1, F.floor(end / _PIECE).cast("int") - first + 1)
    return F.when(end > begin, F.substring(F.array_join(some, ""), begin % _PIECE + 1, end - begin)).otherwise("")


def _matches(text: Column, k: int) -> Column:
    """array<struct<start, k, end, value>> of one kind, in code points.

    Matches and the pieces between them give the positions: a match begins after all
    earlier pieces and matches.  Lengths are summed up in blocks, then over blocks.
    """
    kind, pattern, needs = KINDS[k]
    empty = F.lit(None).cast("array<struct<start:int,k:int,end:int,value:string>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,k:int,end:int,value:string>>").alias("spans"))

    def add(s, x):
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.length(x["match"])
        span = F.struct(begin.alias("start"), F.lit(k).alias("k"), end.alias("end"), x["match"].alias("value"))
        return F.struct(end.alias("at"), F.concat(s["spans"], F.array(span)).alias("spans"))

    def in_blocks(pairs):
        last = F.floor((F.size(pairs) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(pairs, b * _BLOCK + 1, F.lit(_BLOCK)), none, add))

    def shifted(blocks):
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        offsets = F.aggregate(blocks, begin, lambda s, b: F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))["all"]
        move = lambda s, by: F.struct((s["start"] + by).alias("start"), s["k"].alias("k"), (s["end"] + by).alias("end"), s["value"].alias("value"))
        return F.flatten(F.zip_with(blocks, offsets, lambda b, by: F.transform(b["spans"], lambda s: move(s, by))))

    pairs = F.filter(F.zip_with(pieces, found, lambda gap, match: F.struct(gap.alias("gap"), match.alias("match"))), lambda x: x["match"].isNotNull())
    spans = F.filter(_let(_let(pairs, in_blocks), shifted), lambda s: _valid(kind, s["value"]))
    here = F.regexp_like(text, F.lit(pattern))
    if needs:
        here = text.contains(needs) & here
    return F.when(here, spans).otherwise(empty)


def candidates(text: Column) -> Column:
    """All candidate spans of a text with the characters around them, by start and kind."""
    none = F.array().cast("array<struct<start:int,k:int,end:int,value:string>>")
    spans = F.concat(*[F.coalesce(_matches(text, k), none) for k in range(len(KINDS))])

    def placed(found):
        def around(pieces):
            return F.transform(
                F.array_sort(found),
                lambda s: F.struct(
                    s["start"].alias("start"),
                    s["k"].alias("k"),
                    s["end"].alias("end"),
                    s["value"].alias("value"),
                    _between(pieces, F.greatest(s["start"] - _AROUND, F.lit(0)), s["start"]).alias("left"),
                    _between(pieces, s["end"], s["end"] + _AROUND).alias("right"),
                ),
            )

        return F.when(F.size(found) > 0, _let(_pieces(text), around))

    return _let(spans, placed)


def _votes(s: Column) -> list[Column]:
    """One vote for each labeler: 1 personal, -1 not, 0 no opinion."""
    digits = F.regexp_replace(s["value"], "[^0-9]", "")
    distinct = F.size(F.array_distinct(F.split(digits, "(?<=.)(?=.)")))
    strict = F.when(s["k"] < BASE, 1).when(s["value"].rlike(r"^(?:000|666|9[0-9][0-9])-|-00-|-0000$"), -1).otherwise(0)
    known = s["value"].rlike(r"(?i)@(?:gmail|yahoo|hotmail|outlook|mail|example)\.|^(?:4|5[1-5]|3[47]|6011)[0-9 -]{12,}$|^\+(?:1|33|34|44|49) |\.(?:com|org|net|edu|fr|de|es|uk)$|^\([2-9]")
    cued = s["left"].rlike(CUES)
    gazetteer = F.when(known | cued, 1).otherwise(0)
    tight = s["left"].rlike(r"[A-Za-z0-9_#/=$.]$") | s["right"].rlike(r"^[A-Za-z0-9_#/=]")
    context = F.when(tight, -1).otherwise(1)
    shape = F.when((F.length(digits) >= 7) & (distinct <= 2), -1).when(F.length(digits) >= 7, 1).otherwise(0)
    return [strict, gazetteer, context, shape]


def _features(s: Column) -> list[Column]:
    """Discrete features for the span classifier."""
    return [
        F.concat(F.lit("kind="), s["k"].cast("string")),
        F.concat(F.lit("length="), F.least(F.length(s["value"]), F.lit(24)).cast("string")),
        F.concat(F.lit("cue="), s["left"].rlike(CUES).cast("string")),
        F.concat(F.lit("before="), F.when(s["left"] == "", "edge").when(s["left"].rlike(r"\s$"), "space").when(s["left"].rlike("[A-Za-z0-9_]$"), "word").otherwise("mark")),
        F.concat(F.lit("after="), F.when(s["right"] == "", "edge").when(s["right"].rlike(r"^\s"), "space").when(s["right"].rlike("^[A-Za-z0-9_]"), "word").otherwise("mark")),
    ]


def estimate_reliabilities(patterns: DataFrame) -> Column:
    """Two-class Dawid-Skene by EM over rows (votes array<int>, n), as one expression over the collected patterns.

    State: the prior and, for each labeler, class and vote, a smoothed probability.
    The array has one entry for each pattern of votes: a fixed bound.
    """
    rows = F.collect_list(F.struct("votes", "n"))
    start = F.struct(
        F.lit(0.7).alias("prior"),
        F.array(*[F.array(F.lit(0.15), F.lit(0.25), F.lit(0.6)) for _ in range(LABELERS)]).alias("yes"),
        F.array(*[F.array(F.lit(0.5), F.lit(0.3), F.lit(0.2)) for _ in range(LABELERS)]).alias("no"),
    )

    def maximised(model, _):
        judged = F.transform(rows, lambda r: F.struct(r["votes"].alias("votes"), r["n"].alias("n"), posterior(model, r["votes"]).alias("p")))

        def total(weight):
            return F.aggregate(judged, F.lit(0.0), lambda a, r: a + weight(r))

        def table(weight):
            mass = total(weight)

            def share(k, v):
                return (total(lambda r: F.when(r["votes"][k] == v, weight(r)).otherwise(0.0)) + 1.0) / (mass + 3.0)

            return F.array(*[F.array(*[share(k, v) for v in (-1, 0, 1)]) for k in range(LABELERS)])

        return F.struct(
            ((total(lambda r: r["p"] * r["n"]) + 1.0) / (total(lambda r: r["n"].cast("double")) + 2.0)).alias("prior"),
            table(lambda r: r["p"] * r["n"]).alias("yes"),
            table(lambda r: (1.0 - r["p"]) * r["n"]).alias("no"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_STEPS)), start, maximised)


def posterior(model: Column, votes: Column) -> Column:
    """P(personal | votes) under the model."""
    odds = F.log(model["prior"]) - F.log(1.0 - model["prior"])
    for k in range(LABELERS):
        odds = odds + F.log(F.element_at(model["yes"][k], votes[k] + 2)) - F.log(F.element_at(model["no"][k], votes[k] + 2))
    return 1.0 / (1.0 + F.exp(-odds))


def train(spans: DataFrame) -> dict[str, float]:
    """Weights (log odds) of the final classifier from a frame with a struct column `s` of candidates.

    Two aggregations; what reaches the driver is one row for each feature value (fewer than 100).
    """
    voted = spans.select("s", F.array(*_votes(F.col("s"))).alias("votes"))
    patterns = voted.groupBy("votes").agg(F.count("*").alias("n"))
    model = patterns.agg(estimate_reliabilities(patterns).alias("model")).select(F.col("model"))
    judged = voted.crossJoin(F.broadcast(model)).select("s", posterior(F.col("model"), F.col("votes")).alias("p"))  # the model is one row
    sums = (
        judged.select(F.explode(F.array(F.lit("prior"), *_features(F.col("s")))).alias("feature"), "p")
        .groupBy("feature")
        .agg(F.sum(F.round("p", 9)).alias("yes"), F.sum(F.round(1.0 - F.col("p"), 9)).alias("no"))
    )
    total = sums.where("feature = 'prior'").select(F.col("yes").alias("all_yes"), F.col("no").alias("all_no"))
    weights = sums.crossJoin(F.broadcast(total)).select(
        "feature",
        F.when(F.col("feature") == "prior", F.log((F.col("yes") + 1) / (F.col("no") + 1)))
        .otherwise(F.log((F.col("yes") + 0.5) / (F.col("all_yes") + 5)) - F.log((F.col("no") + 0.5) / (F.col("all_no") + 5)))
        .alias("weight"),
    )
    return dict(weights.collect())


def _accepted(s: Column, weights: dict[str, float]) -> Column:
    """Base spans stay; others need a positive score."""
    if not weights:
        return s["k"] < BASE
    table = F.create_map(*[x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))])
    score = reduce(lambda a, b: a + b, [F.coalesce(F.element_at(table, f), F.lit(0.0)) for f in _features(s)], F.lit(weights.get("prior", 0.0)))
    return (s["k"] < BASE) | (score > 0)


def find(df: DataFrame, text: str = "text", spans: str = "pii_spans") -> DataFrame:
    """df with an array of structs (start, k, end, value, left, right) of accepted spans, or null for none.

    Texts are searched once: the candidates are written to the shared folder, the
    classifier is trained on all of them, and then judges them.
    """
    keep = [c for c in df.columns if c.lower() != spans.lower()]
    marked = written(df.select(*[f"`{c}`" for c in keep], candidates(F.coalesce(F.col(text), F.lit(""))).alias(spans)))
    weights = train(marked.where(F.col(spans).isNotNull()).select(F.explode(spans).alias("s")))
    return marked.withColumn(spans, F.filter(spans, lambda s: _accepted(s, weights)))


def _running_ends(spans: Column) -> Column:
    """The greatest end of the spans up to each one, in blocks like the places of matches."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))

    def add(a, end):
        return F.struct(F.greatest(a["at"], end).alias("at"), F.concat(a["all"], F.array(F.greatest(a["at"], end))).alias("all"))

    def in_blocks(ends):
        last = F.floor((F.size(ends) - 1) / _BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.aggregate(F.slice(ends, b * _BLOCK + 1, F.lit(_BLOCK)), none, add))

    def joined(blocks):
        before = F.aggregate(blocks, none, lambda a, b: F.struct(F.greatest(a["at"], b["at"]).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]
        return F.flatten(F.zip_with(blocks, before, lambda b, least: F.transform(b["all"], lambda end: F.greatest(end, least))))

    return _let(_let(F.transform(spans, lambda s: s["end"]), in_blocks), joined)


def masked(text: Column, spans: Column) -> Column:
    """text with each accepted span replaced by its kind in angle brackets; of overlapping spans the first counts."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k, _, _ in KINDS])

    def filled(x):
        # a span that begins inside an earlier one adds no name, but what it covers goes too
        reach = lambda i: F.when(i > 0, x["ends"][i - 1]).otherwise(F.lit(0))
        put = lambda s, i: F.when(s["start"] >= reach(i), F.concat(_between(x["pieces"], reach(i), s["start"]), F.element_at(names, s["k"] + 1))).otherwise("")
        return F.concat(F.array_join(F.transform(x["spans"], put), ""), _between(x["pieces"], F.element_at(x["ends"], -1), x["size"]))

    def prepared(s):
        return F.struct(s.alias("spans"), _running_ends(s).alias("ends"), _pieces(text).alias("pieces"), F.length(text).alias("size"))

    return F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, _let(_let(spans, prepared), filled)).otherwise(text)


def _of_kind(spans: Column, k: int) -> Column:
    return F.filter(spans, lambda s: s["k"] == k)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k, _, _ in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null text counts as empty.  Repeated rows repeat; an empty table gives an empty
    result; only the two columns are read, so other names cannot clash.
    """
    found = _found_ids(df, doc_id, text)
    spans = F.coalesce(F.col("found"), F.array().cast(found.schema["found"].dataType))
    base = F.filter(spans, lambda s: s["k"] < BASE)
    return found.select(
        "doc_id",
        *[F.size(_of_kind(spans, k)).cast("long").alias(f"n_{KINDS[k][0]}") for k in range(BASE)],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def _found_ids(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """As find, without carrying the texts along."""
    marked = written(df.select(F.col(doc_id).alias("doc_id"), candidates(F.coalesce(F.col(text), F.lit(""))).alias("found")))
    weights = train(marked.where(F.col("found").isNotNull()).select(F.explode("found").alias("s")))
    return marked.withColumn("found", F.filter("found", lambda s: _accepted(s, weights)))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
