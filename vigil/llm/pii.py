"""Personal data by weak supervision, in SQL expressions only.

Patterns propose spans; five labelers (strict pattern, gazetteer, context
words, boundary, variety) vote for, against or abstain on each. Votes are counted by
pattern, a table bounded by the labelers. On it expectation-maximisation
estimates each labeler's reliability per kind without labels, and a logistic span classifier
is trained on the posteriors. Spans of the base rules stay whatever it says; it
decides on the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.materialize import materialize
from .common import fresh

BASE_KINDS = ("email", "ip", "card", "phone")      # order of equal starts
KINDS = (*BASE_KINDS, "iban", "local_phone", "secret", "ssn")
EM_ROUNDS = 25
FIT_STEPS = 200
CUT = 0.5
CONTEXT_CHARS = 40
BLOCK = 4096   # characters of a block: a text's characters are reached through its blocks, not counted from its start

#: Base patterns. Possessive repeats and the run's start or the last match's end before a run
#: find the same matches as plain ones without trying every start of a long run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++|\G[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?i:password|passwd|pwd|token|secret|api[_-]?key)"
              r"(?-i: ?[=:] ?\"?)[A-Za-z0-9_/+=-]{8,}+\"?)",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this cannot hold a match.
GUARDS = {"email": "@", "phone": "+", "ip": "[0-9]", "card": "[0-9]", "iban": "[A-Z]{2}[0-9]{2}",
          "local_phone": "[0-9]{4}", "secret": "AKIA|[=:]", "ssn": "[0-9]-[0-9]"}

#: Strict forms of the kinds beyond the base ones.
STRICT = {"iban": r"^[A-Z]{2}[0-9]{2} ?[0-9A-Z ]*[0-9]{6}[0-9A-Z ]*$", "local_phone": r"^\([2-9]",
          "secret": r"^AKIA|[0-9].*[0-9].*[0-9].*[0-9]", "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"}
#: Gazetteers: top-level domains, public first octets, issuers, country codes, countries, key names.
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|info|io|eu|de|fr|es|it|uk|us|ca|au|ch|at|nl)$",
    "ip": r"^(?!0+\.|127\.|255\.|22[4-9]\.|2[3-5][0-9]\.)", "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "iban": r"^(?:AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)", "local_phone": r"^\(?[2-9][0-9]{2}",
    "secret": r"^(?:AKIA|(?i:password|passwd|token|secret|api))", "ssn": r"^[0-7]"}
FOR_WORDS = r"(?i)\b(?:e-?mail|contact|write|reply|phone|tel|telephone|call|mobile|fax|card|visa|credit|iban|account|" \
            r"ip|host|server|ssn|social|login|user|credential|auth)\b"
AGAINST_WORDS = r"(?i)\b(?:version|order|invoice|isbn|issn|part|page|chapter|section|release|build|article|sku)\b"
N_VOTES = 5

_SPAN = "array<struct<start:int,value:string>>"


def _guard(text: Column, kind: str) -> Column:
    g = GUARDS[kind]
    return F.instr(text, g) > 0 if g in ("@", "+") else text.rlike(g)


def running(values: Column, join) -> Column:
    """The array's running totals under an associative ``join``. Each step joins with the total twice as far back and makes
    one new array: n log n in all, where a fold that appends copies the array every time."""
    steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(values))).cast("int") - 1, F.lit(0)))
    return F.aggregate(F.transform(steps, lambda s: F.pow(F.lit(2), s).cast("int")), values, lambda a, back: F.transform(
        a, lambda x, i: F.when(i >= back, join(F.get(a, i - back), x)).otherwise(x)))


def blocks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def between(blocks: Column, a: Column, b: Column) -> Column:
    """The characters from a to b - 1 of a text given in blocks."""
    first, last = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
    at = lambda i: F.coalesce(F.get(blocks, i), F.lit(""))
    return F.when(b <= a, "").when(first == last, F.substring(at(first), a % BLOCK + 1, b - a)).otherwise(F.concat(
        F.substring(at(first), a % BLOCK + 1, F.lit(BLOCK)),
        F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substring(at(last), F.lit(1), b % BLOCK)))


def with_matches(df: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    """Add, per kind, all matches with their starts in code points, under ``names``."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.array().cast("array<string>")
    found = df.withColumns({names[k]: F.when(_guard(t, k), F.regexp_extract_all(t, F.lit(p), F.lit(0)))
                            .otherwise(none) for k, p in PATTERNS.items()})

    def placed(kind: str) -> Column:
        # the pieces between matches and the matches, laid end to end
        m = F.col(names[kind])
        gaps = F.slice(F.split(t, PATTERNS[kind], -1), 1, F.greatest(F.size(m), F.lit(1)))
        ends = running(F.zip_with(gaps, m, lambda g, v: F.char_length(g) + F.char_length(v)), lambda x, y: x + y)
        spans = F.zip_with(ends, m, lambda e, v: F.struct((e - F.char_length(v)).alias("start"), v.alias("value")))
        return F.when(F.size(m) > 0, spans).otherwise(F.array().cast(_SPAN))

    return found.withColumns({names[k]: placed(k) for k in PATTERNS})


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda d: d.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The base check of a match; kinds beyond the base have none."""
    n = F.length(_digits(value))
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return (n >= 14) & (n <= 19) & luhn(value)
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _votes(kind: str, blocks: Column, s: Column) -> Column:
    """The five labelers' votes on a span: 1 for, -1 against, 0 abstains."""
    value, start = s["value"], s["start"]
    end = start + F.char_length(value)
    before = between(blocks, F.greatest(start - CONTEXT_CHARS, F.lit(0)), start)
    around = F.concat(F.substring(before, -1, 1), between(blocks, end, end + 1))
    yes_no = lambda c: F.when(c, 1).otherwise(-1)
    strict = F.lit(1) if kind in BASE_KINDS else yes_no(value.rlike(STRICT[kind]))
    return F.array(strict, yes_no(value.rlike(GAZETTEER[kind])),
                   F.when(before.rlike(FOR_WORDS), 1).when(before.rlike(AGAINST_WORDS), -1).otherwise(0),
                   yes_no(~around.rlike("[A-Za-z0-9]")),
                   yes_no(F.size(F.array_distinct(F.split(value, ""))) >= 5))


def candidates(blocks: Column, names: dict[str, str]) -> Column:
    """All checked spans: (start, rank of kind, end, kind, votes), sorted."""
    def of(kind: str) -> Column:
        ok = F.filter(F.col(names[kind]), lambda s: holds(kind, s["value"]))
        return F.transform(ok, lambda s: F.struct(
            s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
            (s["start"] + F.char_length(s["value"])).alias("end"), F.lit(kind).alias("kind"),
            _votes(kind, blocks, s).alias("votes")))
    return F.array_sort(F.concat(*[of(k) for k in PATTERNS]))


def with_candidates(docs: DataFrame, text: str, out: str) -> DataFrame:
    names = {k: fresh([*docs.columns, out], f"m_{k}") for k in PATTERNS}
    found = with_matches(docs, text, names)
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    some = F.lit(False)
    for k in PATTERNS:
        some = some | (F.size(F.col(names[k])) > 0)
    cut = fresh([*docs.columns, out, *names.values()], "blocks")
    found = found.withColumn(cut, F.when(some, blocks_of(t)))
    kind = "array<struct<start:int,rank:int,end:int,kind:string,votes:array<int>>>"
    return found.withColumn(out, F.when(some, candidates(F.col(cut), names)).otherwise(F.array()).cast(kind)).select(*docs.columns, out)


# ------------------------------------------------------------------ label model and classifier

def _let(value: Column, then) -> Column:
    """Bind an expression to a name, so it is evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def em(patterns: Column, rounds: int = EM_ROUNDS) -> Column:
    """Per kind: (prior, reliability of each labeler, posterior of each vote pattern).

    ``patterns``: array of (votes, n). A labeler that votes is right with its reliability, labelers err independently,
    and abstaining says nothing; Beta priors (8 right of 10) keep its sign.
    """
    total = F.aggregate(patterns, F.lit(0.0), lambda a, x: a + x["n"])

    def posterior(prior: Column, right: Column) -> Column:
        weights = F.transform(right, lambda r: F.log(r / (1 - r)))
        return F.transform(patterns, lambda x: _sigmoid(
            F.log(prior / (1 - prior)) + _dot(x["votes"].cast("array<double>"), weights)))

    def state(prior: Column, right: Column) -> Column:
        return F.struct(prior.alias("prior"), right.alias("right"), posterior(prior, right).alias("p"))

    def step(s: Column, _: Column) -> Column:
        pairs = F.arrays_zip(patterns.alias("x"), s["p"].alias("p"))
        prior = (F.aggregate(pairs, F.lit(0.0), lambda a, z: a + z["x"]["n"] * z["p"]) + 1) / (total + 2)

        def reliability(i: Column) -> Column:
            vote = lambda z: F.get(z["x"]["votes"], i)
            agree = F.aggregate(pairs, F.lit(0.0), lambda a, z: a + z["x"]["n"] * F.when(
                vote(z) == 1, z["p"]).when(vote(z) == -1, 1 - z["p"]).otherwise(0.0))
            voted = F.aggregate(pairs, F.lit(0.0), lambda a, z: a + F.when(vote(z) != 0, z["x"]["n"]).otherwise(0.0))
            return (agree + 8) / (voted + 10)
        right = F.transform(F.sequence(F.lit(0), F.lit(N_VOTES - 1)), reliability)
        return _let(F.struct(prior.alias("prior"), right.alias("right")), lambda z: state(z["prior"], z["right"]))

    first = state(F.lit(0.7), F.array(*[F.lit(0.8)] * N_VOTES))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step)


def _features(votes: Column, rank: Column) -> Column:
    """A bias, the votes and the kind."""
    return F.concat(F.array(F.lit(1.0)), votes.cast("array<double>"), F.transform(
        F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda k: F.when(k == rank, 1.0).otherwise(0.0)))


def fit_classifier(spans: DataFrame) -> DataFrame:
    """One row (weights): the span classifier, from candidate arrays ``spans`` (found).

    Votes are counted per kind and pattern, at most 3^5 each; kinds weigh alike in the fit.
    """
    counts = (spans.select(F.explode("found").alias("s")).groupBy("s.kind", "s.rank", "s.votes")
              .agg(F.count(F.lit(1)).cast("double").alias("n")))
    # at most 243 patterns a kind
    kinds = counts.groupBy("kind", "rank").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    learned = kinds.withColumn("m", em(F.col("patterns"))).select(
        "rank", F.explode(F.arrays_zip(F.col("patterns").alias("x"), F.col("m.p").alias("p"))).alias("z"),
        F.aggregate("patterns", F.lit(0.0), lambda a, x: a + x["n"]).alias("total"))
    rows = learned.select(F.struct(
        _features(F.col("z.x.votes"), F.col("rank")).alias("f"), F.col("z.p").alias("p"),
        (F.col("z.x.n") / F.col("total") / len(KINDS)).alias("c")).alias("r"))
    rows = rows.agg(F.array_sort(F.collect_list("r")).alias("rows"))   # at most 8 * 243 rows
    n = 1 + N_VOTES + len(KINDS)

    def step(w: Column, _: Column) -> Column:
        off = F.transform(F.col("rows"), lambda r: r["c"] * (_sigmoid(_dot(w, r["f"])) - r["p"]))
        return _let(off, lambda e: F.transform(w, lambda x, j: x - 2.0 * (F.aggregate(
            F.zip_with(e, F.col("rows"), lambda a, r: a * F.get(r["f"], j)), F.lit(0.0),
            lambda s, a: s + a) + 0.001 * x)))

    return rows.select(F.aggregate(F.sequence(F.lit(1), F.lit(FIT_STEPS)), F.array(*[F.lit(0.0)] * n),
                                   step).alias("weights"))


def weights_of(spans: DataFrame) -> Column:
    """The classifier's 14 weights, read once and put in the plan."""
    return F.array(*[F.lit(w) for w in fit_classifier(spans).first()["weights"]])


def chosen(found: Column, weights: Column, cut: float = CUT) -> Column:
    """The base spans, and of the others those the classifier accepts that touch no base span."""
    base = lambda s: s["rank"] < len(BASE_KINDS)
    # spans stand by their starts: a base span before one touches it if it ends later, one behind it if it starts earlier
    ends = running(F.transform(found, lambda s: F.when(base(s), s["end"]).otherwise(0)), lambda x, y: F.greatest(x, y))
    starts = F.reverse(running(F.reverse(F.transform(found, lambda s: F.when(base(s), s["start"]).otherwise(1 << 30))),
                               lambda x, y: F.least(x, y)))

    def keep(z: Column, s: Column, i: Column) -> Column:
        clear = (F.get(z["ends"], i) <= s["start"]) & (F.get(z["starts"], i) >= s["end"])
        return base(s) | (clear & (_sigmoid(_dot(weights, _features(s["votes"], s["rank"]))) >= cut))
    picked = _let(F.struct(ends.alias("ends"), starts.alias("starts")),
                  lambda z: F.filter(found, lambda s, i: keep(z, s, i)))
    return F.when(F.size(found) > 0, picked).otherwise(found)


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of ``docs`` (doc_id, text).

    Texts are read once; their candidate spans are checkpointed. A null text is empty: no spans, the hash of
    nothing; repeated rows are searched each; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    spans = materialize(with_candidates(rows, "text", "found").select("doc_id", "found"))
    weights = weights_of(spans)
    base = F.filter("found", lambda s: s["rank"] < len(BASE_KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(k) for k in BASE_KINDS]
    return spans.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"),
                        _listed(chosen(F.col("found"), weights)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every chosen span of ``text`` replaced by its kind, as in [EMAIL]; an ``n_chars`` column follows
    the new text. Overlapping spans are replaced as one. Rows without spans, and null texts, stay as they are.
    """
    out = fresh(docs.columns, "found")
    cut, reach = (fresh([*docs.columns, out], x) for x in ("blocks", "reach"))
    rows = with_candidates(docs, text, out)
    # spans alone are written: over the plan itself, a filter that explode brings would repeat the whole search
    weights = weights_of(materialize(with_candidates(docs.select(F.col(text).alias("text")), "text", "found").select("found")))
    picked = rows.withColumn(out, chosen(F.col(out), weights))

    spans, blocks = F.col(out), F.col(cut)
    picked = picked.withColumns({cut: F.when(F.size(out) > 0, blocks_of(F.col(text))),
                                 reach: running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))})

    def piece(s: Column, i: Column) -> Column:
        done = F.when(i == 0, 0).otherwise(F.get(F.col(reach), i - 1))
        return F.when(s["start"] >= done, F.concat(between(blocks, done, s["start"]), F.lit("["), F.upper(s["kind"]),
                                                   F.lit("]"))).otherwise("")
    tail = between(blocks, F.element_at(reach, -1), F.char_length(F.col(text)))
    new = F.concat(F.array_join(F.transform(spans, piece), ""), tail)
    done = picked.withColumn(text, F.when(F.size(out) > 0, new).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.size(out) > 0, F.char_length(text).cast("long"))
                               .otherwise(F.col("n_chars")))
    return done.select(*docs.columns)
