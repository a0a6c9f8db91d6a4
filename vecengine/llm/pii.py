"""Personal data by weak supervision: labelers vote on candidate spans, and what they agree on trains a classifier.

Spans of the base patterns (e-mail and network addresses, card and phone numbers) always count.
Beside them one pattern finds candidates of other forms: spelled-out or defanged addresses, national
phone numbers, cards of 13 to 15 digits, and base forms that fail their check.  On each candidate five
labelers vote for, against, or not at all: its form's check, a gazetteer (endings of hosts, calling
codes, card issuers, address ranges), words before it that tell what it is, words that tell what it is
not, and the characters beside it.  Candidates are counted by kind, votes and features, and
expectation-maximisation over those counts estimates how far each labeler is to be believed.  Its
posteriors are the soft labels of the final classifier, naive Bayes over the candidates' features
(votes and shape).  A candidate of another form is added if its probability is ``ADDED`` or more; one
of a base form that fails its check never is, and serves as evidence only.

All of it is columns and grouped sums: patterns are possessive and anchored, so each passes a text
once; what goes through the driver is one row a kind, labeler and vote (or feature and value).

Defined results: a null text is an empty one and has no spans.  Rows are judged each by itself (but
for the estimates, which all candidates make together), so repeated rows get equal results; a null id
is kept.  Without candidates the estimates are the priors.  Texts of any length are read whole.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
#: The least probability of a span that is added to the base ones.
ADDED = 0.9
#: Rounds of expectation-maximisation, and characters of context on either side.
ROUNDS, CONTEXT = 12, 40
#: Array elements that are folded at once.
CHUNK = 256

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# The base patterns of the contract, written so that no run of characters is read twice: a match starts where
# the one before ended or where its first run starts.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT, _DOT = r" ?+[\[({] ?+(?:at|AT|@) ?+[\])}] ?+", r" ?+[\[({] ?+(?:dot|DOT|\.) ?+[\])}] ?+"
#: Other forms, by kind.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:{_AT}{_HOST}++(?:(?:{_DOT}|\.| dot ){_HOST}++)++| at {_HOST}++(?: dot {_HOST}++)++)",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])",
}
#: One pattern of all candidates; what matches none of the forms is a run of digits.  An address starts where its run
#: does: were it to start after any match, the rest of a run would be read again and again.
CANDIDATE = "|".join([BASE["email"].replace(r"\G|", ""), BASE["phone"], BASE["ip"], LOOSE["email"], LOOSE["ip"], LOOSE["phone"], BASE["card"]])

# What the gazetteers and the context labelers know.
HOST_ENDINGS = "com org net edu gov mil int info biz io co de fr es it nl be at ch uk eu us ca au jp cn in br ru pl se no dk fi pt mx ar example".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 421 971 972".split()
ISSUERS = r"^(?:4|5[0-8]|2[2-7]|35|6)"
SHORT_ISSUERS = r"^(?:3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|4[0-9]{12})$"
TELLING = {
    "email": "e-?mail|mail|correo|courriel|contact|contacto|kontakt|write|reach|address|adresse",
    "ip": "ip|host|server|servidor|serveur|address|adresse|dirección|ping|login|client",
    "card": "card|credit|debit|visa|mastercard|amex|karte|kreditkarte|tarjeta|carte|payment|pay",
    "phone": "phone|tel|telephone|telefon|teléfono|téléphone|call|fax|mobile|cell|handy|móvil|whatsapp|sms|ring",
}
DENYING = "version|ver|release|isbn|issn|doi|order|invoice|ref|reference|serial|sku|part|build|token|hash|checksum|section|article|page|chapter"


def scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], empty: Column) -> Column:
    """``step(state, item) -> (state, result)`` along an array; the array of results, of the type of ``empty``.

    An array that grows is copied at each step, so results are put together by chunks of CHUNK.
    """
    starts = F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(CHUNK))

    def one(acc: Column, item: Column) -> Column:
        after, result = step(acc["s"], item)
        return F.struct(after.alias("s"), F.concat(acc["o"], F.array(result)).alias("o"))

    def some(acc: Column, start: Column) -> Column:
        done = F.aggregate(F.slice(items, start, F.lit(CHUNK)), F.struct(acc["s"].alias("s"), empty.alias("o")), one)
        # the chunk is folded once: a fold over an array of one element names it
        return F.aggregate(F.array(done), acc, lambda a, d: F.struct(d["s"].alias("s"), F.concat(a["o"], F.array(d["o"])).alias("o")))

    nested = F.array(empty)
    whole = F.aggregate(starts, F.struct(state.alias("s"), nested.alias("o")), some)
    return F.flatten(whole["o"])


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has its check digit right."""
    doubled = F.transform(F.split(F.reverse(number), "(?<=.)(?=.)"), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(2 * x.cast("int") - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def valid(kind: str, hit: Column) -> Column:
    """Whether a match of the kind's base pattern passes the kind's check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return hit.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits(hit)).between(16, 19), luhn(digits(hit))).otherwise(False)
    return F.length(digits(hit)).between(8, 15)


_SPAN = "array<struct<start:bigint,end:bigint,hit:string,left:string,right:string>>"


def matches(docs: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """``docs`` with a column a pattern: the array of its matches' places (code points), with the text on either side."""
    hits = docs.withColumns({f"{n}_hits": F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for n, p in patterns.items()})
    gaps = hits.withColumns({f"{n}_gaps": F.when(F.size(f"{n}_hits") > 0, F.split(F.col(text), p, -1)).otherwise(F.array().cast("array<string>")) for n, p in patterns.items()})
    out = {}
    for n in patterns:
        # before, match and after: the gap before a match is an element of its own, so there is one gap more than matches
        items = F.arrays_zip(F.slice(F.col(f"{n}_gaps"), F.lit(1), F.size(f"{n}_hits")).alias("g"), F.col(f"{n}_hits").alias("h"), F.slice(F.col(f"{n}_gaps"), F.lit(2), F.greatest(F.size(f"{n}_hits"), F.lit(1))).alias("a"))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            start = at + F.length(x["g"])
            end = start + F.length(x["h"])
            span = F.struct(start.alias("start"), end.alias("end"), x["h"].alias("hit"), F.right(x["g"], F.lit(CONTEXT)).alias("left"), F.left(x["a"], F.lit(CONTEXT)).alias("right"))
            return end, span

        empty = F.array().cast(_SPAN)
        out[n] = F.when(F.size(f"{n}_hits") > 0, scan(items, F.lit(0).cast("long"), step, empty)).otherwise(empty)
    return gaps.withColumns(out).drop(*[f"{n}_{x}" for n in patterns for x in ("hits", "gaps")])


def _judged(span: Column) -> Column:
    """A candidate as ``(kind, form, start, end, votes, features)``; kind null where it is of none."""
    hit, left, right, d = span["hit"], span["left"], span["right"], digits(span["hit"])
    n = F.length(d)
    loose = {k: hit.rlike(f"^(?:{p})$") for k, p in LOOSE.items()}
    plain = {
        "email": hit.contains("@") & ~hit.rlike(r"[\[({]"),
        "ip": hit.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"),
        "phone": hit.startswith("+"),
    }
    abroad = hit.startswith("00") & n.between(10, 15)
    kind = (
        F.when(plain["email"] | loose["email"], "email").when(plain["phone"], "phone").when(plain["ip"] | loose["ip"], "ip")
        .when(loose["phone"] | abroad, "phone").when(n.between(13, 19), "card")
    )
    passes = (
        F.when(kind == "email", plain["email"]).when(kind == "phone", plain["phone"] & valid("phone", hit))
        .when(kind == "ip", plain["ip"] & valid("ip", hit)).otherwise(valid("card", hit))
    )
    form = F.when(passes, "base").when(plain["email"] | plain["phone"] | plain["ip"] | ((kind == "card") & (n > 15)), "failed").otherwise("loose")
    # the votes
    first = F.when(kind == "ip", F.lit(0)).when((kind == "card") & (form == "loose"), F.when(luhn(d), 1).otherwise(-1))
    check = F.when(form == "base", 1).when(form == "failed", -1).otherwise(F.coalesce(first, F.lit(0)))
    ending = F.lower(F.regexp_extract(hit, "([A-Za-z0-9-]+)$", 1))
    code = F.regexp_extract(d, f"^(?:00)?({'|'.join(sorted(CALLING_CODES, key=lambda c: (-len(c), c)))})", 1)
    known = (
        F.when(kind == "email", F.when(ending.isin(HOST_ENDINGS), 1).when(ending.rlike("^[0-9]"), -1).otherwise(0))
        .when((kind == "phone") & (plain["phone"] | abroad), F.when(code != "", 1).otherwise(-1))
        .when(kind == "phone", F.when(d.rlike("^[2-9]"), 1).otherwise(-1))
        .when(kind == "card", F.when(F.when(n > 15, d.rlike(ISSUERS)).otherwise(d.rlike(SHORT_ISSUERS)), 1).otherwise(-1))
        .otherwise(F.when(d.rlike("^0") | hit.rlike("^[0-9](?:[^0-9]+[0-9]){3}$"), -1).otherwise(1))
    )
    word = lambda ws: rf"(?i)(?<![\p{{L}}0-9])(?:{ws})(?![\p{{L}}0-9])"
    tells = F.lit(False)
    for k, ws in TELLING.items():
        tells = tells | ((kind == k) & left.rlike(word(ws)))
    denies = left.rlike(word(DENYING))
    beside = F.concat(F.right(left, F.lit(1)), F.lit(" "), F.left(right, F.lit(1)))
    edge = F.when(beside.rlike(r"[A-Za-z0-9_/=#]"), -1).otherwise(1)
    votes = F.array(check, known, F.when(tells, 1).otherwise(0), F.when(denies, -1).otherwise(0), edge)
    bucket = F.when(n < 8, "few").when(n < 13, "some").when(n < 16, "many").otherwise("most")
    marks = F.when(hit.rlike("[()]"), "brackets").when(hit.rlike("[-.]"), "marks").when(hit.contains(" "), "spaces").otherwise("none")
    features = F.array(
        F.concat(F.lit("check:"), check.cast("string")), F.concat(F.lit("known:"), known.cast("string")), F.concat(F.lit("tells:"), tells.cast("string")),
        F.concat(F.lit("denies:"), denies.cast("string")), F.concat(F.lit("edge:"), edge.cast("string")), F.concat(F.lit("digits:"), bucket), F.concat(F.lit("marks:"), marks),
    )
    return F.struct(kind.alias("kind"), form.alias("form"), span["start"].alias("start"), span["end"].alias("end"), votes.alias("votes"), features.alias("features"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, <kind>..., found)`` of every row: the base spans of each kind, and the judged candidates; stored, without texts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = matches(rows, "text", BASE | {"found": CANDIDATE}).drop("text")
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    passing = lambda k: lambda s: valid(k, s["hit"])
    base = {k: F.transform(F.filter(k, passing(k)), place) for k in KINDS}
    # runs of few digits are no candidates
    likely = F.filter("found", lambda s: s["hit"].rlike(r"[@+\[({.]| at ") | (F.length(digits(s["hit"])) >= 10))
    judged = F.filter(F.transform(likely, _judged), lambda c: c["kind"].isNotNull())
    return stored(spans.select("doc_id", *[v.alias(k) for k, v in base.items()], judged.alias("found")), "pii-candidates")


class Model:
    """How far each labeler is to be believed, and the classifier's weights: log odds by ``kind|feature``."""

    def __init__(self, reliability: dict[str, float], weights: dict[str, float]):
        self.reliability, self.weights = reliability, weights

    def probability(self, candidate: Column) -> Column:
        return _sigmoid(_sum(candidate["features"], candidate["kind"], self.weights))


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _sum(features: Column, kind: Column, weights: dict[str, float]) -> Column:
    """The weights of a candidate's features and of its kind added up; what is not known counts nothing."""
    if not weights:
        return F.lit(0.0)
    known = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    one = lambda f: F.coalesce(F.try_element_at(known, F.concat_ws("|", kind, f)), F.lit(0.0))
    return F.aggregate(features, one(F.lit("prior")), lambda a, f: a + one(f))


def _belief(name: str, value: str) -> tuple[float, float]:
    for_, against = BELIEF.get(name, ((2, 2), (2, 2)))
    return {"1": for_, "-1": against}.get(value, (2, 2))


def _odds(rows) -> dict[str, float]:
    """Log odds of each value, from soft counts ``(kind, name, value, yes, no)`` and what is first believed."""
    totals: dict[tuple, list[float]] = {}
    for r in rows:
        for i, x in enumerate((r.yes, r.no)):
            totals.setdefault((r.kind, r.name), [0.0, 0.0])[i] += x
    out = {}
    for r in rows:
        a, b = _belief(r.name, r.value)
        yes, no = totals[r.kind, r.name]
        out[f"{r.kind}|{r.name}:{r.value}"] = math.log((r.yes + a) / (yes + 8)) - math.log((r.no + b) / (no + 8))
        out[f"{r.kind}|prior"] = math.log((yes + 1) / (no + 1))
    return out


#: What is first believed of each labeler, as counts of candidates that are and are not what they seem: by a vote for, and by one against.
BELIEF = {"l0": ((8, 1), (1, 20)), "l1": ((3, 1), (1, 3)), "l2": ((8, 1), (1, 1)), "l3": ((1, 1), (1, 8)), "l4": ((3, 2), (1, 6))}


def train(found: DataFrame, rounds: int = ROUNDS) -> Model:
    """Estimates over all candidates, whose counts by kind, votes and features are a table of bounded size."""
    each = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n"))
    counts = stored(each, "pii-counts").coalesce(1)  # at most some thousands of rows
    named = F.transform("votes", lambda v, i: F.concat(F.concat(F.lit("l"), i.cast("string")), F.lit(":"), v.cast("string")))
    votes = counts.withColumn("features_", F.col("features")).withColumn("features", named)

    def estimate(rows: DataFrame, p: Column) -> dict[str, float]:
        parts = rows.withColumn("p", p).select("kind", "n", "p", F.explode("features").alias("f"))
        cut = F.split("f", ":", 2)
        told = parts.groupBy("kind", cut[0].alias("name"), cut[1].alias("value")).agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
        return _odds(told.collect())  # a row a kind, name and value

    first = {f"{k}|{l}:{v}": math.log(b[0] / b[1]) for k in KINDS for l, pair in BELIEF.items() for v, b in zip((1, -1), pair, strict=True)}  # noqa: E741
    p = _sigmoid(_sum(F.col("features"), F.col("kind"), first))
    reliability: dict[str, float] = {}
    for _ in range(rounds):
        new = estimate(votes, p)
        done = reliability.keys() == new.keys() and max((abs(new[k] - reliability[k]) for k in new), default=0.0) < 1e-3
        reliability = new
        p = _sigmoid(_sum(F.col("features"), F.col("kind"), reliability))
        if done:
            break
    labelled = votes.withColumn("label", p)
    weights = estimate(labelled.select("kind", "n", "label", F.col("features_").alias("features")), F.col("label"))
    return Model(reliability, weights)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = ADDED) -> DataFrame:
    """``(doc_id, base, spans)`` of every row: arrays of ``(kind, start, end)``, by kind and start; ``spans`` has the added ones too."""
    found = candidates(docs, id_col, text_col)
    model = train(found)
    named = lambda k: lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    kind = lambda k: lambda c: c["kind"] == k
    base = {k: F.transform(k, named(k)) for k in KINDS}
    chosen = F.filter("found", lambda c: (c["form"] == "loose") & (model.probability(c) >= threshold))
    rows = found.withColumn("chosen", chosen)
    whole = [F.array_sort(F.concat(base[k], F.transform(F.filter("chosen", kind(k)), named(k)))) for k in KINDS]
    return rows.select("doc_id", F.concat(*base.values()).alias("base"), F.concat(*whole).alias("spans"))


def told(found: Column) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
