"""Personal data by weak supervision, in SQL functions only.

Candidate spans come from regular expressions, strict (base) and loose ones:
written-out or spaced e-mail addresses, defanged and long IP addresses, card
numbers with other separators or a wrong last digit, phone numbers without a
plus or with signs and line breaks between their parts.  Labelers vote on each
candidate, yes, no or abstain:

* ``format``: a strict pattern says yes; a loose one abstains;
* ``gazetteer``: known top-level domains, issuer prefixes, area codes, reserved
  address ranges;
* ``before``: a word near before the candidate names the kind;
* ``check``: Luhn's digit, the range of the parts, the form of a name;
* ``against``: a word near before it names something else, as a version;
* ``alone``: it stands by itself, or is a piece of a longer run.

Expectation-maximisation estimates how reliable each labeler is (two classes,
labelers independent given the class, even classes before the votes, as base
spans would outnumber all doubts) from the counts
of the vote patterns, of which there are at most ``len(KINDS) * 3**6``, however
large the corpus.  The posteriors train the final span classifier, a logistic
regression for each kind on what the span looks like, not on the votes: the
signs beside it, its number of digits, its separators, the words before it and
its check.  It sees counts by feature combination, at most ``4 * 9600`` rows.
Candidates of at least ``threshold`` are added to the base spans; base spans
stay in any case, and an added one overlaps none.

A null text is an empty one.  Without candidates nothing is added.  Repeated
rows get equal results; the key may be null or repeated.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import SPAN, matches
from .tables import stored

# fixed values: kinds and base patterns
KINDS = ["email", "ip", "card", "phone"]
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
# looser forms of the same kinds, which only votes can confirm: kind, pattern, and what a text with a match must hold
LOOSE = [
    (0, r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20?[\[({<](?:at|@)[\])}>]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[({<](?:dot|\.)[\])}>]|\.)\x20?[A-Za-z0-9-]{2,63}){1,4}", r"(?i)[\[({<](at|@)[\])}>]"),
    (0, r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}\x20(?:at|@)\x20[A-Za-z0-9-]{1,63}(?:\x20(?:dot|\.)\x20[A-Za-z0-9-]{2,63}){1,4}(?![A-Za-z0-9])", r"(?i)\x20(at|@)\x20[A-Za-z0-9-]+\x20(dot|\.)\x20"),
    (1, r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", r"(?:[0-9A-Fa-f]{1,4}:){7}"),
    (1, r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[({]\.[\])}]\x20?[0-9]{1,3}){3}(?![0-9.])", r"[0-9]\x20?[\[({]\.[\])}]"),
    (2, r"(?<![0-9])[0-9]{4}([._/– ])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])", r"[0-9]{4}[._/– ][0-9]{4}"),
    (2, r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9]|[\x20-][0-9])", r"[0-9](?:[\x20-]?[0-9]){12}"),
    (3, r"(?<![0-9+(.-])(?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}\)?[\x20.-][0-9]{3}"),
    (3, r"(?<![0-9])00[1-9][0-9]?[\x20.-][\x20().0-9-]{6,18}[0-9](?![0-9])", r"00[1-9]"),
    (3, r"\+[0-9]{1,3}[^0-9A-Za-z]{1,8}[0-9]{2,5}(?:[^0-9A-Za-z]{1,8}[0-9]{2,5}){1,3}(?![0-9])", r"\+[0-9]{1,3}[^0-9A-Za-z]{1,8}[0-9]{2}"),
]
# fixed values: gazetteers and context words by kind
TOP_LEVEL = r"(?i)\b(?:com|net|org|edu|gov|int|info|biz|io|co|uk|de|fr|es|it|nl|eu|us|ca|ch|at|be|se|no|dk|fi|pl|pt|ie|jp|cn|in|br|mx|au|nz)$"
ISSUER = r"^(?:4|5[1-5]|2[2-7]|3[4-7]|30|6011|65|62)"
CONTEXT = [
    r"(?i)\b(?:e-?mail|mail|mailto|contact|write|kontakt|correo|courriel|adresse?)\b",
    r"(?i)\b(?:ip|ipv[46]|host|server|address|adresse|from|client|login)\b",
    r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|cc)\b",
    r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|anruf|appel|m[oó]vil|tel[eé]fono)\b",
]
AGAINST = r"(?i)(?:\bv|\bversion|\bver\.?|\bisbn|\border|\binvoice|\bsku|\bsection|\bchapter|\bdoi|[$€£#])[\x20:.]*$"
VOTES = ["format", "gazetteer", "before", "check", "against", "alone"]
FEATURES = ["left", "right", "digits", "separators", "context", "check"]
_NEAR = 40
# by kind, what must hold for the kind's check
NAME = r"(?i)^[a-z0-9](?:[a-z0-9._%+ -]{0,62}[a-z0-9])?\x20?[\[({<]?(?:@|at)[\])}>]?\x20?[a-z0-9]"
ADDRESS = r"^(?!0)(?:[0-9]+(?:[\[({\x20]*\.[\])}\x20]*[0-9]+){3}|[0-9A-Fa-f:]+)$"
RESERVED = r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\b"


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(body: Column) -> Column:
    """Whether the digits of ``body`` pass Luhn's check."""
    d = F.reverse(_digits(body))
    places = F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1)))

    def part(i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(places, F.lit(0), lambda acc, i: acc + F.coalesce(part(i), F.lit(1))) % 10 == 0


def base_matches(text: Column) -> list[Column]:
    """For each kind, the matches of its base pattern that pass its test."""
    n = lambda m: F.length(_digits(m["body"]))
    return [
        matches(text, EMAIL, text.contains("@")),
        F.filter(matches(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda m: m["body"].rlike(PART)),
        F.filter(matches(text, CARD, text.rlike(r"[0-9][\x20-]?[0-9]")), lambda m: F.when(n(m).between(13, 19), luhn(m["body"])).otherwise(False)),
        F.filter(matches(text, PHONE, text.contains("+")), lambda m: n(m).between(9, 15)),
    ]


def _vote(yes: Column | bool, no: Column | bool = False) -> Column:
    yes, no = (F.lit(x) if isinstance(x, bool) else x for x in (yes, no))
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _sign(c: Column) -> Column:
    """What a neighbouring sign is: none or white space, letter, digit, another."""
    return F.when(c.rlike(r"^\s?$"), "s").when(c.rlike(r"^[\p{L}_]"), "l").when(c.rlike("^[0-9]"), "d").otherwise("p")


def _candidate(text: Column, kind: int, strict: bool):
    def made(m: Column) -> Column:
        body = m["body"]
        near = F.substr(text, F.greatest(m["start"] + 1 - _NEAR, F.lit(1)), F.least(m["start"], F.lit(_NEAR)))
        left, right = _sign(F.right(near, F.lit(1))), _sign(F.substr(text, m["end"] + 1, F.lit(1)))
        n, for_it, against = F.length(_digits(body)), near.rlike(CONTEXT[kind]), near.rlike(AGAINST)
        gazetteer = [
            _vote(body.rlike(TOP_LEVEL), ~body.rlike(TOP_LEVEL)),
            _vote(False, body.rlike(RESERVED)),
            _vote(_digits(body).rlike(ISSUER), ~_digits(body).rlike(ISSUER)),
            _vote(_digits(body).rlike(r"^(?:1|00)?[2-9][0-9]{2}[2-9]"), _digits(body).rlike(r"^0{3}|^(.)\1+$")),
        ][kind]
        check = [body.rlike(NAME), body.rlike(ADDRESS), luhn(body), n.between(9, 15)][kind]
        embedded = left.isin("l", "d") | right.isin("l", "d")
        votes = [_vote(strict), gazetteer, _vote(for_it), _vote(check, ~check), _vote(False, against), _vote(~embedded, embedded)]
        bare = F.regexp_replace(body, "[A-Za-z0-9]", "")
        shown = [
            left,
            right,
            F.when(n < 9, "a").when(n < 13, "b").when(n < 16, "c").when(n == 16, "d").otherwise("e"),
            F.when(bare == "", "0").when(bare.rlike(r"^\x20+$"), "1").when(bare.rlike(r"^[.@-]+$"), "2").when(bare.rlike(r"^[\x20().:-]+$"), "3").otherwise("4"),
            F.when(against, "-").when(for_it, "+").otherwise("0"),
            F.when(check, "+").otherwise("-"),
        ]
        pattern = F.concat(F.lit(f"{kind}"), *[F.element_at(F.array(F.lit("-"), F.lit("0"), F.lit("+")), v + 2) for v in votes])
        look = F.concat(F.lit(f"{kind}"), *shown)
        return F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lit(strict).alias("base"), pattern.alias("pattern"), look.alias("look"))

    return made


CANDIDATES = "array<struct<kind:int,start:int,end:int,base:boolean,pattern:string,look:string>>"


def _apart(found: Column, others: Column) -> Column:
    """Those of ``found`` that overlap none of ``others``."""
    return F.filter(found, lambda c: ~F.exists(others, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))


def base_candidates(text: Column) -> Column:
    """The base spans of ``text`` (not null)."""
    return F.concat(*[F.transform(m, _candidate(text, kind, True)) for kind, m in enumerate(base_matches(text))]).cast(CANDIDATES)


def loose_candidates(text: Column) -> Column:
    """Spans of the looser forms, by kind; they may overlap."""
    return F.concat(*[F.transform(matches(text, pattern, text.rlike(sign)), _candidate(text, kind, False)) for kind, pattern, sign in LOOSE]).cast(CANDIDATES)


def _first_of_overlapping(found: Column) -> Column:
    """By start, the longer one first: each that begins where the last kept one has ended."""
    ordered = F.array_sort(F.transform(found, lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("less"), c["kind"].alias("kind"))))
    spans = F.transform(ordered, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), (-c["less"]).alias("end")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    step = lambda acc, c: F.when(c["start"] >= acc["at"], F.struct(c["end"].alias("at"), F.array_append(acc["out"], c).alias("out"))).otherwise(acc)
    return F.aggregate(spans, start, step, lambda acc: acc["out"])


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def expectation_maximisation(counts: dict[str, int], rounds: int = 40) -> dict[str, float]:
    """The probability that a candidate is personal data, by vote pattern.

    Starts with what any labeler rejects as unlikely, the rest by the share of
    yes votes; estimates are smoothed by one candidate for each vote and class.
    """
    post = {p: 0.1 if "-" in p else (1 + p.count("+")) / (2 + p.count("+")) for p in counts}
    for _ in range(rounds):
        yes = 1 + sum(n * post[p] for p, n in counts.items())
        no = 1 + sum(n * (1 - post[p]) for p, n in counts.items())
        table: dict[tuple[int, str], list[float]] = {}
        for p, n in counts.items():
            for k, v in enumerate(p[1:]):
                cell = table.setdefault((k, v), [1.0, 1.0])
                cell[0] += n * post[p]
                cell[1] += n * (1 - post[p])
        for p in counts:
            odds = 0.0
            for k, v in enumerate(p[1:]):
                if v != "0":  # an abstention says nothing
                    a, b = table[k, v]
                    odds += math.log(a / yes) - math.log(b / no)
            post[p] = _sigmoid(odds)
    return post


def train_classifier(looks: dict[str, tuple[int, float]], steps: int = 300, rate: float = 2.0, decay: float = 1e-3) -> dict[str, float]:
    """Logistic regression on the posteriors; its probability by look.

    ``looks`` has for each combination of features the number of candidates
    and the sum of their posteriors.  Every kind has its own weights.
    """
    own = {look: [look[0], *[f"{look[0]}{k}{v}" for k, v in enumerate(look[1:])]] for look in looks}
    w = dict.fromkeys([f for fs in own.values() for f in fs], 0.0)
    total: dict[str, int] = {}
    for look, (n, _) in looks.items():
        total[look[0]] = total.get(look[0], 0) + n
    for _ in range(steps):
        g = {f: decay * x for f, x in w.items()}
        for look, (n, yes) in looks.items():
            e = (n * _sigmoid(sum([w[f] for f in own[look]])) - yes) / total[look[0]]
            for f in own[look]:
                g[f] += e
        w = {f: x - rate * g[f] for f, x in w.items()}
    return {look: _sigmoid(sum([w[f] for f in fs])) for look, fs in own.items()}


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: its key, ``base`` and ``spans``.

    Both are arrays of spans, sorted by kind, then start.  The columns ``keep``
    are carried along.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{c}`").alias(f"__keep_{c}") for c in keep]
    found = docs.select(F.col(f"`{key}`").alias("__key"), *kept, base_candidates(body).alias("__base"), loose_candidates(body).alias("__loose"))
    found = stored(found.withColumn("__loose", _apart(F.col("__loose"), F.col("__base"))), "pii")
    each = found.select(F.explode(F.concat("__base", "__loose")).alias("c")).select("c.pattern", "c.look")
    counts = {r["pattern"]: r["count"] for r in each.groupBy("pattern").count().collect()}  # bounded: kinds times votes
    chance: dict[str, float] = {}
    if counts:
        post = expectation_maximisation(counts)
        millionths = F.create_map(*[F.lit(x) for p in sorted(post) for x in (p, round(post[p] * 1_000_000))])  # whole numbers have one sum
        seen = each.groupBy("look").agg(F.count("*").alias("n"), F.sum(F.element_at(millionths, F.col("pattern"))).alias("yes")).collect()  # bounded: kinds times features
        chance = train_classifier({r["look"]: (r["n"], r["yes"] / 1_000_000) for r in sorted(seen)})
    accepted = F.array(*[F.lit(p) for p, x in sorted(chance.items()) if x >= threshold]).cast("array<string>")
    added = _first_of_overlapping(F.filter("__loose", lambda c: F.array_contains(accepted, c["look"])))
    plain = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    base = F.transform("__base", plain)
    return found.select(
        F.col("__key").alias(key),
        *[F.col(f"__keep_{c}").alias(c) for c in keep],
        F.array_sort(base).alias("base"),
        F.array_sort(F.concat(base, added)).alias("spans"),
    )
