"""Personal data by weak supervision, in DataFrame operations only.

Candidate spans come from generous patterns. Labelers (exact formats, a gazetteer of domains, number
ranges and key prefixes, words before the span, its neighbouring characters) vote yes, no or nothing
on each. Expectation-maximisation over the counted vote patterns estimates, for each kind, how
reliable each labeler is and how likely each pattern is personal data; those probabilities, as soft
labels, train the final classifier, which sees the span's own shape and the characters beside it and
no votes. What leaves the tables for this is one row for each distinct pattern, whose number does not
depend on the data.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The method looks for one kind more than the base has: keys and tokens that open something.
ALL_KINDS = (*KINDS, "secret")
#: Fixed forms of the base: leftmost, not overlapping, per kind. The guards in front only spare the
#: search starts that cannot begin a match, or that a longer match at an earlier start covers.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A chain of digits with single separators that has 14 to 19 of them, from its first to its last.
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a valid mail may lack or be written with, and numbers without the plus sign.
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[({] ?dot ?[\])}]) ?[A-Za-z0-9-]{1,63}){1,4}",
    "phone": r"(?<![+0-9A-Za-z.(-])(?<![0-9][ -])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[ .-][0-9])",
    "card": r"(?<![0-9A-Za-z.+-])(?<![0-9][ ])(?:[0-9]{4}(?:[ .–_/][0-9]{4}){3}|[0-9]{14,19})(?![0-9A-Za-z]|[ .–_/-][0-9])",
    "ip": r"(?i)(?<![0-9a-f:.])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:.])",
    # A run of 20 or more letters and digits that has both; signs that keys hold may stand between.
    "secret": r"(?<![A-Za-z0-9_+/=.@-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}(?![A-Za-z0-9@])",
}
#: Words that stand before personal data of a kind, fixed.
CONTEXT = {
    "email": "mail|contact|write|reach|address|courriel|correo|kontakt",
    "ip": "ip|host|server|address|login|from|adresse",
    "card": "card|visa|mastercard|amex|pay|carte|karte|tarjeta|number",
    "phone": "phone|tel|call|mobile|fax|cell|contact|telefon|appel|llame|ring",
    "secret": "token|secret|passw|pwd|api|key|auth|bearer|credential|clave|clé|kennwort|schlüssel",
}
#: What keys of common services begin with, fixed.
PREFIXES = "sk[-_]|pk[-_]|ghp_|gho_|glpat-|xox[abprs]-|AKIA|ASIA|AIza|eyJ"
#: Top-level domains that mail addresses end in, fixed.
DOMAINS = "com|org|net|edu|gov|io|co|info|biz|de|fr|es|uk|us|eu|it|nl|ch|at|be"
VOTES = ("format", "gazetteer", "context", "neighbourhood")


def _luhn(digits: Column) -> Column:
    """Whether 14 to 19 digits pass the Luhn check."""
    backwards = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(20):
        d = F.ascii(F.substring(backwards, 20 - i, 1)) - 48
        total = total + (d if i % 2 == 0 else d * 2 - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)



SPAN = "struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,shape:string>"
_PLACED = "array<struct<start:int,end:int,span:string>>"


def _may_have(kind: str, text: Column, base: bool) -> Column:
    """A cheap test that spares most texts the search; true wherever a pattern of the kind matches."""
    if kind == "email":
        return F.contains(text, F.lit("@")) if base else text.rlike(r"(?i)[\[({] ?at ?[\])}]")
    if kind == "phone":
        return F.contains(text, F.lit("+")) if base else text.rlike("[0-9]{3}[ .-][0-9]{4}")
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]") if base else text.rlike("(?i)[0-9a-f]:[0-9a-f]")
    if kind == "secret":
        return text.rlike("[A-Za-z0-9_+/-]{20}")
    return text.rlike(r"[0-9](?:[ -]?[0-9]){13}") if base else text.rlike("[0-9]{4}[ .–_/][0-9]{4}|[0-9]{14}")


def _matches(pattern: str, text: Column) -> Column:
    """Array of (start, end, span) of all matches; offsets in code points, end exclusive.

    A split gives what lies between the matches, so running sums of both lengths place them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_PLACED).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["span"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["span"].alias("span")))).alias("out"))

    return F.aggregate(F.arrays_zip(gaps.alias("gap"), found.alias("span")), begin, step)["out"]


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, span: Column, before: Column, after: Column, base: bool) -> Column:
    """One vote of each of VOTES: 1 for personal data, -1 against, 0 for nothing to say."""
    digits = F.regexp_replace(span, "[^0-9]", "")
    if kind == "email":
        form, gaz = _vote(span.rlike("[.][A-Za-z]{2,6}$"), span.rlike("[0-9]$")), _vote(span.rlike(rf"(?i)[.\])}} ](?:{DOMAINS})$"), F.lit(False))
    elif kind == "ip":
        form, gaz = _vote(_valid("ip", span) if base else F.lit(True), F.lit(True)), _vote(span.rlike("^(?:[1-9]|0{0,3}:|[1-9a-fA-F])"), span.rlike("^0|^255"))
    elif kind == "card":
        form, gaz = _vote(_luhn(digits), F.lit(True)), _vote(digits.rlike("^[3-6]"), digits.rlike("^[01789]"))
    elif kind == "secret":
        n, others = F.length(span), F.length(F.regexp_replace(span, "[^0-9]", ""))
        plain = (others * 10 < n) | span.rlike("(?:^|[/_-])[a-z]{3,}(?:[/_-]|$)")  # a path, or words with a number
        mixed = span.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & (n >= 32) | span.rlike("(?=.*[a-z])(?=.*[A-Z])") & (n >= 24)
        form, gaz = _vote(mixed & ~plain, plain), _vote(span.rlike(f"^(?:{PREFIXES})"), F.lit(False))
    else:
        form, gaz = _vote(F.length(digits).between(10, 15), F.lit(True)), _vote(digits.rlike("^[2-9]") | span.startswith("+"), digits.rlike("^[01]"))
    near = _vote(before.rlike(rf"(?i)(?:{CONTEXT[kind]})[^0-9\n]*$"), F.lit(False))
    edge = _vote(before.rlike(r"(?:^|\s)$") & after.rlike(r"^(?:$|[\s.,;:!?)])"), before.rlike(r"[=\"'/_#]$") | after.rlike(r"^[=\"'/_#]"))
    return F.array(form, gaz, near, edge)


def _beside(c: Column) -> Column:
    """The class of the character at one side of a span."""
    return F.when(c == "", "end").when(c.rlike(r"\s"), "space").when(c.rlike("[\"'`]"), "quote").when(c.rlike("[=:]"), "sets").when(c.rlike("[.,;!?)(]"), "point").otherwise("other")


def _shape(kind: str, span: Column, before: Column, after: Column, base: bool) -> Column:
    """The features of the final classifier, each within the span's kind.

    They are the pattern (base or wide), the length, the share of digits, the make-up of letters and
    separators, the characters beside the span, the last word before it if that is one of CONTEXT, and
    for card numbers whether the check digit is right.
    """
    n = F.length(span)
    share = F.length(F.regexp_replace(span, "[^0-9]", "")) * 4 / n
    letters = F.when(span.rlike("^[0-9a-f]+$"), "hex").when(span.rlike("[a-z]") & span.rlike("[A-Z]"), "mixed").when(span.rlike("[A-Za-z]"), "letters").otherwise("none")
    word = F.lower(F.regexp_extract(before, rf"(?i)({CONTEXT[kind]})[^A-Za-z0-9]{{0,6}}$", 1))
    return F.concat_ws("|", F.lit(f"{kind}{'' if base else '*'}"), F.concat(F.lit("n"), F.least(F.floor(n / 6), F.lit(8)).cast("string")), F.concat(F.lit("d"), F.floor(share).cast("string")), F.when(span.rlike("[ (]"), "spaced").when(span.rlike("[./_–-]"), "joined").otherwise("tight"), letters, _beside(F.right(before, F.lit(1))), _beside(F.left(after, F.lit(1))), word, F.when(_luhn(F.regexp_replace(span, "[^0-9]", "")), "sum").otherwise("") if kind == "card" else F.lit(""))


def _voted(kind: str, base: bool, found: Column, text: Column) -> Column:
    """Array of SPAN from the matches of one pattern; base matches that are not valid go."""

    def span(x: Column) -> Column:
        before = F.substring(text, F.greatest(F.lit(1), x["start"] - 39), F.least(F.lit(40), x["start"]))
        after = F.substring(text, x["end"] + 1, F.lit(2))
        return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(base).alias("base"), _votes(kind, x["span"], before, after, base).alias("votes"), _shape(kind, x["span"], before, after, base).alias("shape")).cast(SPAN)

    return F.transform(F.filter(found, lambda x: _valid(kind, x["span"])) if base else found, span)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """For each row of docs: doc_id, spans (array of SPAN, base matches and wider ones), and ``keep``.

    A base match counts only if it is valid (parts of addresses at most 255, card numbers that pass
    Luhn, phones of 10 to 15 digits). A wider match that overlaps a base match of any kind goes, and
    so does a secret that overlaps another wider match. Null and empty texts have no spans. Kept columns keep their names unless they are one of these two.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    rows = rows.withColumn("_digit", text.rlike("[0-9]"))
    made = {}
    for base, patterns in ((True, BASE), (False, WIDE)):
        for kind, pattern in patterns.items():
            test = _may_have(kind, text, base)
            if kind in ("card", "phone") or kind == "ip" and base:
                test = F.col("_digit") & test
            name = f"_{kind}{int(base)}"
            rows = rows.withColumn(name, F.when(test, _matches(pattern, text)).otherwise(F.array().cast(_PLACED)))
            made[name] = F.when(F.size(name) > 0, _voted(kind, base, F.col(name), text)).otherwise(F.array().cast(f"array<{SPAN}>"))
    strict = F.concat(*[v for k, v in made.items() if k.endswith("1")])
    loose = F.concat(*[v for k, v in made.items() if k.endswith("0") and "secret" not in k])

    def apart(found: str, taken: str) -> Column:
        return F.filter(found, lambda x: ~F.exists(taken, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))

    rows = rows.withColumn("_strict", strict).withColumn("_loose", loose).withColumn("_open", made["_secret0"])
    rows = rows.withColumn("_spans", F.when(F.size("_loose") == 0, F.col("_strict")).otherwise(F.concat("_strict", apart("_loose", "_strict"))))
    spans = F.when(F.size("_open") == 0, F.col("_spans")).otherwise(F.concat("_spans", apart("_open", "_spans")))
    return rows.select("doc_id", spans.alias("spans"), *[F.col(f"_keep_{c}").alias(c) for c in keep])


def estimate(patterns: list[tuple[tuple[int, ...], str, int]], rounds: int = 50) -> tuple[dict, dict]:
    """Reliabilities by EM, and the classifier trained on its posteriors, from counted patterns.

    patterns: (votes, shape, count). Each labeler's chance of each vote is estimated for spans that
    are and are not personal data, starting from the votes' mean, with one pseudo-count a cell. The
    classifier is a naive Bayes over the parts of the shape, fitted to the posteriors as soft labels. Returns (vote log-odds, shape log-odds), each with the prior under the
    key None.
    """
    rows = [(v, s.split("|"), n) for v, s, n in patterns]
    soft = [min(0.95, max(0.05, 0.5 + 0.4 * sum(v) / max(1, sum(map(abs, v))))) for v, _, _ in rows]
    votes: dict = {None: 0.0}
    for _ in range(rounds):
        mass = [1.0 + sum(n * (p if y else 1 - p) for p, (_, _, n) in zip(soft, rows, strict=True)) for y in (0, 1)]
        cell: dict = defaultdict(lambda: [1.0, 1.0])
        for p, (v, _, n) in zip(soft, rows, strict=True):
            for j, x in enumerate(v):
                cell[j, x][0] += n * (1 - p)
                cell[j, x][1] += n * p
        votes = {k: math.log(b / (mass[1] + 2)) - math.log(a / (mass[0] + 2)) for k, (a, b) in cell.items()}
        for j in range(len(VOTES)):  # a labeler never argues against its own vote
            votes[j, 1], votes[j, -1] = max(0.0, votes.get((j, 1), 0.0)), min(0.0, votes.get((j, -1), 0.0))
        votes[None] = math.log(mass[1] / mass[0])
        soft = [1 / (1 + math.exp(-max(-30.0, min(30.0, votes[None] + sum(votes.get((j, x), 0.0) for j, x in enumerate(v)))))) for v, _, _ in rows]
    mass = [1.0, 1.0]
    cell = defaultdict(lambda: [1.0, 1.0])
    for p, (_, parts, n) in zip(soft, rows, strict=True):
        for y, q in enumerate((1 - p, p)):
            mass[y] += n * q
            for j, x in enumerate(parts):
                cell[j, x][y] += n * q
    shapes = {k: math.log(b / (mass[1] + 2)) - math.log(a / (mass[0] + 2)) for k, (a, b) in cell.items()}
    shapes[None] = math.log(mass[1] / mass[0])
    return votes, shapes


def fit(found: DataFrame) -> dict[str, tuple[dict, dict]]:
    """A model for each kind from all candidate spans; what is collected is counted patterns, a bounded number."""
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.shape").agg(F.count("*").alias("n"))
    by_kind: dict[str, list] = {k: [] for k in ALL_KINDS}
    for r in counted.orderBy("kind", "votes", "shape").collect():
        by_kind[r["kind"]].append((tuple(r["votes"]), r["shape"], r["n"]))
    return {k: estimate(v) for k, v in by_kind.items() if v}


def _score(span: Column, model: dict[str, tuple[dict, dict]]) -> Column:
    """The classifier's probability: the prior of the span's kind and one weight for each part of its shape."""
    parts = F.split(span["shape"], "\\|")
    out = F.lit(0.0)
    for kind, (_, shapes) in sorted(model.items()):
        terms = [F.lit(float(shapes[None]))]
        for j in sorted({k[0] for k in shapes if k is not None}):
            own = sorted((x, w) for k, w in shapes.items() if k is not None and k[0] == j for x in (k[1],))
            terms.append(F.element_at(F.create_map(*[F.lit(y) for x, w in own for y in (x, float(w))]), parts[j]))
        score = F.lit(1.0) / (F.lit(1.0) + F.exp(-reduce(add, [F.coalesce(t, F.lit(0.0)) for t in terms])))
        out = F.when(span["kind"] == kind, score).otherwise(out)
    return out


def label(found: DataFrame, model: dict[str, tuple[dict, dict]], threshold: float = 0.5) -> DataFrame:
    """``found`` with spans: all base ones, and the wider ones that score above the threshold, in order.

    Each has kind, start, end and base; the order is by start, then kind as in ALL_KINDS, then end.
    """
    rank = lambda k: F.array_position(F.array(*map(F.lit, ALL_KINDS)), k)
    taken = F.filter("spans", lambda x: x["base"] | (_score(x, model) > threshold))
    keyed = F.array_sort(F.transform(taken, lambda x: F.struct(x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"))))
    empty = F.size("spans") == 0
    out = F.transform(keyed, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base")))
    kept = "array<struct<kind:string,start:int,end:int,base:boolean>>"
    return found.withColumn("spans", F.when(empty, F.array().cast(kept)).otherwise(out.cast(kept)))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or each run of overlapping spans, replaced by its kind in brackets."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, x["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))
