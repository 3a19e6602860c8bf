"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Everything that touches text is a DataFrame function. Only counts of vote patterns, a bounded table, come to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import durable, text_of

#: Characters of context before and after a candidate that labelers see.
BEFORE, AFTER = 32, 8


@dataclass(frozen=True)
class Kind:
    """A kind of span: where to look, what a match must be, and what speaks for and against it."""

    name: str
    needs: tuple[str, ...]  # a text without all of these has none
    regex: str
    base: bool = False
    strict: str = ".*"  # a plain form
    near: str = "(?!)"  # words before that speak for it
    known: str = "(?!)"  # a gazetteer of parts that are in real use
    dubious: str = "(?!)"  # of parts that aren't anyone's


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
#: Patterns of the contract first, in its order, with possessive loops: they match the same and can't run deep or twice.
KINDS = (
    Kind("email", ("@",), r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", True, r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,12}$", r"(?i)\b(e-?mail|mail|contact|write|reach)\b", r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$", r"(?i)^(no-?reply|postmaster|example)@"),
    Kind("ip", (".",), r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", True, r"^[1-9][0-9]{0,2}(\.(0|[1-9][0-9]{0,2})){3}$", r"(?i)\b(ip|address|host|server|from|login)\b", r"^([1-9][0-9]?|1[013-9][0-9]|12[0-68-9]|2[01][0-9]|22[0-3])\.", r"^(0|10|127|255)\.|^192\.168\."),
    Kind("card", (), r"[0-9](?:[ -]?+[0-9])++", True, r"^[0-9]{16}$|^[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$", r"(?i)\b(card|visa|credit|debit|payment|account)\b", r"^(4|5[1-5]|2[2-7]|6011|65|35|62)", r"^(0|1|7|8|9)"),
    Kind("phone", ("+",), r"\+[0-9][ ().0-9-]+[0-9]", True, r"^\+[1-9][0-9]{0,2}[ .-]?\(?[0-9]{1,4}\)?([ .-]?[0-9]{2,4}){2,4}$", r"(?i)\b(phone|tel|call|mobile|fax|dial)\b", r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])[ (.0-9-]", r"^\+0"),
    Kind("local_phone", ("(", ")"), r"(?<![0-9+)(] ?)\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[-. ][0-9]{4}(?![0-9])", False, r"^\([2-9][0-9]{2}\) [2-9][0-9]{2}-[0-9]{4}$", r"(?i)\b(phone|tel|call|mobile|fax|dial)\b", r"^\([2-9][0-8][0-9]\)", r"^\(([2-9])\1\1\)"),
    Kind("masked_email", ("at",), r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,}+ ?[\[(] ?at ?[\])] ?[a-z0-9-]{2,}+ ?[\[(] ?dot ?[\])] ?[a-z]{2,}+\b", False, r".*", r"(?i)\b(e-?mail|mail|contact|write|reach)\b", r"(?i)(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"),
    Kind("national_id", ("-",), r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", False, r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", r"(?i)\b(ssn|social|security|tax|id)\b", r"^[0-7]", r"^(000|666|9)|-00-|-0000$"),
    Kind("secret", (), r"(?i)\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\b ?[=:] ?[\"']?[A-Za-z0-9+/_=.-]{16,}+[\"']?", False, r"^[^=:]*[=:][^0-9]*[0-9]", r"(?i)\b(config|env|export|login|auth|header|key)\b", r"^[^=:]*[=:] ?[\"']?(?=[^\"']*[0-9])(?=[^\"']*[A-Za-z])[^\"']*[\"']?$", r"(?i)example|changeme|placeholder|x{6}|(.)\1{7}"),
    Kind("person", (".",), r"\b(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]++ [A-Z][a-z]++\b", False, r".*", r"(?i)\b(name|dear|contact|from|by)\b", r"(?i) (james|john|mary|anna|maria|peter|paul|david|sarah|laura|thomas|julia|carlos|jean|pierre|hans) "),
)
NAMES = [k.name for k in KINDS]
LABELERS = ("strict", "gazetteer", "context", "edges")


def _valid(kind: str, value: Column) -> Column:
    """What the contract asks of a match beyond its pattern; a failing one is dropped, not tried again."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _vote(for_: Column, against: Column) -> Column:
    return F.when(against, -1).when(for_, 1).otherwise(0).cast("tinyint")


_SPAN = "array<struct<kind: tinyint, start: bigint, end: bigint, strict: tinyint, gazetteer: tinyint, context: tinyint, edges: tinyint, long: tinyint, shape: tinyint, lead: tinyint>>"
#: What the classifier sees of a span's own text, besides the votes: classes of length, of letters and digits, and whether
#: a sign that announces a value stands before.
SEEN = {"long": 3, "shape": 3, "lead": 2}


def _bound(f, k: Kind, i: int):
    return lambda acc, x: f(k, i, acc, x)


def with_candidates(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with an array of candidate spans of column text: kind, start, end (code points), votes and classes (SEEN).

    Matches of a pattern and what lies between them are read off the same scan rule, so a match starts where the lengths
    before it end. A null or empty text has no spans; each row keeps its own, whatever other columns there are, but for
    names like _m0 and _p0, which are taken.
    """
    columns = docs.columns
    for i, k in enumerate(KINDS):
        has = F.lit(True)
        for part in k.needs:
            has = has & F.contains(F.lower(text) if k.regex.startswith("(?i)") else F.col(text), F.lit(part))
        docs = docs.withColumn(f"_m{i}", F.when(has, F.regexp_extract_all(text, F.lit(k.regex), 0)))
    for i, k in enumerate(KINDS):
        docs = docs.withColumn(f"_p{i}", F.when(F.size(f"_m{i}") > 0, F.split(text, k.regex, -1)))
    spans = []
    for i, k in enumerate(KINDS):
        n, m, p = F.size(f"_m{i}"), F.col(f"_m{i}"), F.col(f"_p{i}")
        met = F.zip_with(F.zip_with(m, F.slice(p, 1, n), lambda v, b: F.struct(v.alias("v"), F.length(b).cast("long").alias("gap"), F.right(b, F.lit(BEFORE)).alias("b"))), F.slice(p, 2, n), lambda x, a: F.struct(x["v"].alias("v"), x["gap"].alias("gap"), x["b"].alias("b"), F.left(a, F.lit(AFTER)).alias("a")))

        def place(k, i, acc, x):
            start = acc["pos"] + x["gap"]
            end = start + F.length(x["v"])
            votes = (
                _vote(x["v"].rlike(k.strict), ~x["v"].rlike(k.strict)),
                _vote(x["v"].rlike(k.known), x["v"].rlike(k.dubious)),
                _vote(x["b"].rlike(k.near), x["b"].rlike(r"(?i)\b(version|section|figure|isbn|order|page|chapter)\W*$")),
                _vote(~(x["b"].rlike("[A-Za-z0-9]$") | x["a"].rlike("^[A-Za-z0-9]")), x["b"].rlike("[A-Za-z0-9]$") | x["a"].rlike("^[A-Za-z0-9]")),
            )
            size = F.length(x["v"])
            span = F.struct(F.lit(i).cast("tinyint").alias("kind"), start.alias("start"), end.alias("end"), *(v.alias(n) for v, n in zip(votes, LABELERS, strict=True)), F.when(size < 12, 0).when(size < 24, 1).otherwise(2).cast("tinyint").alias("long"), F.when(~x["v"].rlike("[0-9]"), 0).when(x["v"].rlike("[A-Za-z]"), 1).otherwise(2).cast("tinyint").alias("shape"), x["b"].rlike(r"[:=]\s*[\"'(]?$").cast("tinyint").alias("lead"))
            return F.struct(end.alias("pos"), F.when(_valid(k.name, x["v"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        first = F.struct(F.lit(0).cast("long").alias("pos"), F.expr(f"cast(array() as {_SPAN})").alias("out"))
        spans.append(F.when(n > 0, F.aggregate(met, first, _bound(place, k, i), lambda acc: acc["out"])).otherwise(F.expr(f"cast(array() as {_SPAN})")))
    return docs.select(*columns, F.concat(*spans).alias(out))


def reliabilities(rows: list[tuple[int, tuple[int, ...], float]], rounds: int = 50) -> tuple[list[float], dict[tuple, float]]:
    """EM over (kind, votes, count): each labeler's chance to be right when it votes, and each pattern's chance to be true."""
    right, prior = [0.8] * len(LABELERS), {k: 0.7 for k, _, _ in rows}
    post: dict[tuple, float] = {}
    for _ in range(rounds):
        for k, votes, _ in rows:
            yes, no = prior[k], 1 - prior[k]
            for r, v in zip(right, votes, strict=True):
                yes, no = yes * (1 if not v else r if v > 0 else 1 - r), no * (1 if not v else 1 - r if v > 0 else r)
            post[k, votes] = yes / (yes + no)
        for j in range(len(LABELERS)):
            cast = sum(n for _, v, n in rows if v[j])
            good = sum(n * (post[k, v] if v[j] > 0 else 1 - post[k, v]) for k, v, n in rows if v[j])
            right[j] = min(0.99, (good + 8) / (cast + 10))  # a weak belief that labelers know more than chance
        for kind in prior:
            own = [(post[k, v], n) for k, v, n in rows if k == kind]
            prior[kind] = (sum(p * n for p, n in own) + 1.4) / (sum(n for _, n in own) + 2)
    return right, post


def features(kind: int, votes: tuple[int, ...], seen: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(kind == k) for k in range(len(KINDS))), *map(float, votes), *(float(v == c) for v, n in zip(seen, SEEN.values(), strict=True) for c in range(n))]


def logistic(rows: list[tuple[list[float], float, float]], rounds: int = 200, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic regression on (features, soft label, count): gradient steps with a bound on curvature."""
    if not rows:
        return []
    total = sum(n for _, _, n in rows)
    w = [0.0] * len(rows[0][0])
    step = 4 / max(sum(x * x for x in f) for f, _, _ in rows)
    for _ in range(rounds):
        slope = [decay * x for x in w]
        for f, y, n in rows:
            off = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, f, strict=True)))))) - y)
            for j, x in enumerate(f):
                if x:
                    slope[j] += off * x
        w = [a - step * g for a, g in zip(w, slope, strict=True)]
    return w


def fitted(candidates: DataFrame, column: str) -> list[float]:
    """The span classifier's weights from all candidates: counts of patterns are summed by Spark, then EM and the fit.

    At most kinds x 3^labelers x classes (SEEN) patterns exist, whatever the corpus.
    """
    rows = candidates.select(F.explode(column).alias("s")).groupBy("s.kind", *(f"s.{x}" for x in (*LABELERS, *SEEN))).count().collect()
    votes = sorted((r["kind"], tuple(r[x] for x in LABELERS), tuple(r[x] for x in SEEN), r["count"]) for r in rows)
    counts: dict[tuple, float] = {}
    for k, v, _, n in votes:
        counts[k, v] = counts.get((k, v), 0.0) + n
    _, post = reliabilities([(k, v, n) for (k, v), n in counts.items()])
    return logistic([(features(k, v, s), post[k, v], float(n)) for k, v, s, n in votes])


def accepted(weights: list[float]):
    """A test on a span: base kinds stay, others where the classifier says one half at least."""
    base = sum(k.base for k in KINDS)

    def test(s: Column) -> Column:
        if not weights:
            return s["kind"] < base
        rest = iter(weights)
        take = lambda n: [next(rest) for _ in range(n)]
        one_of = lambda name, n: F.element_at(F.array(*map(F.lit, take(n))), s[name].cast("int") + 1)
        score = F.lit(take(1)[0]) + one_of("kind", len(KINDS))
        for w, name in zip(take(len(LABELERS)), LABELERS, strict=True):
            score = score + F.lit(w) * s[name]
        for name, n in SEEN.items():
            score = score + one_of(name, n)
        return (s["kind"] < base) | (score >= 0)

    return test


def decided(spans: Column, weights: list[float]) -> Column:
    """Accepted spans; one of the added kinds that overlaps a base span is left out."""
    base = sum(k.base for k in KINDS)
    kept = F.filter(spans, accepted(weights))
    return F.filter(kept, lambda s: (s["kind"] < base) | ~F.exists(kept, lambda b: (b["kind"] < base) & (b["start"] < s["end"]) & (s["start"] < b["end"])))


def listed(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"].cast("int") + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, votes) of each row of docs (doc_id, text).

    Base kinds (email, ip, card, phone) are all kept; other kinds where the classifier accepts them. Spans come by kind,
    then start. Null and empty texts have none; equal rows get equal spans; an empty table gives an empty one. Rows don't
    meet: only the candidates (no texts) are written between the two passes.
    """
    found = durable(with_candidates(docs.select("doc_id", text_of().alias("_text")), "_text", "spans").select("doc_id", "spans"))
    return found.select("doc_id", decided(F.col("spans"), fitted(found, "spans")).alias("spans"))


def _of_kind(i: int):
    return lambda s: s["kind"] == i


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of find_spans()."""
    base = [i for i, k in enumerate(KINDS) if k.base]
    counts = [F.size(F.filter("spans", _of_kind(i))).cast("long").alias(f"n_{KINDS[i].name}") for i in base]
    return found.select("doc_id", *counts, F.sha2(listed(F.filter("spans", lambda s: s["kind"] < len(base))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each accepted span of text replaced by its kind in angle brackets; spans that overlap become one.

    All columns stay; a null text stays null, repeated rows are redacted alike, an empty table gives an empty one. The candidates are found twice, once to fit and once beside the text, so
    that no text is shuffled.
    """
    base = docs.withColumn("_text", text_of())
    weights = fitted(durable(with_candidates(base.select("_text"), "_text", "_spans").select("_spans")), "_spans")
    names = F.array(*map(F.lit, NAMES))
    by_start = F.array_sort(F.transform(decided(F.col("_spans"), weights), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc, s):
        fresh = s["start"] >= acc["pos"]
        piece = F.concat(acc["out"], F.substring(F.col("_text"), (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int")), F.lit("<"), F.upper(F.element_at(names, s["kind"].cast("int") + 1)), F.lit(">"))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))
    text = F.when(F.size("_found") == 0, F.col("text")).otherwise(F.aggregate("_found", first, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), (acc["pos"] + 1).cast("int"), F.lit(2**31 - 1)))))
    found = with_candidates(base, "_text", "_spans").withColumn("_found", by_start)
    return found.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns))
