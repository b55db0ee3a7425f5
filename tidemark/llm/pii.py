"""Personal data by weak supervision: labelers vote on spans, a model learned from the votes decides.

Everything is a Spark expression. Texts are searched row by row; what is
learned needs the counts of vote patterns only, a table of bounded size.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import stored

KINDS = ["email", "ip", "card", "phone"]

# What belongs to a local part and to a label of a host name.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_HEX = "[0-9A-Fa-f]{1,4}"
_AT, _DOT = r"[\[(] ?[aA][tT] ?[\])]", r"[\[(] ?[dD][oO][tT] ?[\])]"

# Top-level domains.
TOP_LEVEL = (
    "com org net edu gov mil int info biz name io ai app dev co me tv eu uk us ca au nz ie in za de at ch fr be lu nl "
    "es pt it gr se no dk fi is pl cz sk hu ro bg hr si rs ua ru tr il ae sa jp cn kr tw hk sg my th vn id ph br ar cl mx"
).split()

#: What is looked at, per kind: all that the base pattern matches, by patterns
#: that take time in proportion to the text (a run of word characters is tried
#: once, loops do not give back), or another spelling. A spelling never holds
#: the begin of a base match, so base matches are the same with and without it.
ZONES = {
    "email": [
        rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++(?:"
        rf"@{_LABEL}++(?:\.{_LABEL}++)++"
        rf"| ?{_AT} ?{_LABEL}++(?:(?: ?{_DOT} ?|\.){_LABEL}++)++(?!{_LOCAL}*+@)"
        rf"| at {_LABEL}++(?: dot {_LABEL}++){{0,4}}? dot (?:{'|'.join(TOP_LEVEL)})(?!{_LABEL}|{_LOCAL}*+@))"
    ],
    "ip": [
        r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        rf"(?={_HEX}:)(?<![0-9A-Za-z:.])(?=[A-Fa-f:]{{0,39}}[0-9])(?:{_HEX}:){{7}}{_HEX}(?![0-9A-Za-z:]|\.[0-9])",
        rf"(?={_HEX}:)(?<![0-9A-Za-z:.])(?=[A-Fa-f:]{{0,39}}[0-9])(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}(?![0-9A-Za-z:]|\.[0-9])",
    ],
    # Shorter runs hold no card; those of 13 digits on are candidates.
    "card": ["[0-9](?:[ -]?[0-9]){12,}+"],
    "phone": [
        r"\+[0-9][ ().0-9-]+[0-9]",
        r"(?=[(0-9])(?<![0-9A-Za-z+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
        r"(?=00)(?<![0-9A-Za-z+])00[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9])",
    ],
}


def _may_hold(kind: str, text: Column) -> Column:
    """False only for texts that hold no match of the kind's zones; cheap, for most texts hold none."""
    def holds(*marks: str) -> Column:
        return functools.reduce(operator.or_, (F.contains(text, F.lit(m)) for m in marks))

    if kind == "email":
        return holds("@", " dot ") | text.rlike(_AT)
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]") | text.rlike(f":(?:{_HEX})?:")
    if kind == "card":
        return text.rlike(ZONES[kind][0])
    return holds("+") | text.rlike("[0-9][ .-]?[0-9]{4}")


#: Candidates inside a base match that fails its test, such as a card with a house number before it.
INSIDE = {
    "card": [
        r"(?<![0-9])[0-9]{13,19}(?![0-9])",
        r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\3[0-9]{4}\3[0-9]{1,4}(?![0-9])",
        r"(?<![0-9])[0-9]{4}([ -])[0-9]{6}\4[0-9]{4,5}(?![0-9])",
    ],
    "phone": [
        r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
        r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])",
    ],
}

# Fixed values of the other gazetteers.
#: Country calling codes.
CALLING = (
    r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
    r"|(?:2[1-69]|35|37|38|42|50|59|6[7-9]|80|85|88|96|97|99)[0-9])"
)
#: Number ranges of card issuers.
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[0-9]|6[0-9]|8)"
#: Addresses that name no host on the net.
NOT_PUBLIC = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\."

#: Words before a span that speak for it, and against.
CONTEXT = {
    "email": (r"(?:e-?mail|mail|contact|write|reach|kontakt|correo|courriel)\b", r"(?:password|passwort|git|ssh)\b"),
    "ip": (r"(?:ip|address|addr|host|server|from|login)\b", r"(?:version|release|section|chapter|v|ver)\b"),
    "card": (r"(?:card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)\b",
             r"(?:token|hash|isbn|order|invoice|serial|id|key)\b"),
    "phone": (r"(?:phone|tel|call|mobile|cell|fax|telefon|teléfono|téléphone)\b", r"(?:isbn|order|invoice|id|serial)\b"),
}

BEFORE, AFTER = 32, 16
VOTERS = ["pattern", "check", "gazetteer", "context", "border", "variety"]
N_TRAITS = 3


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` reads it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def running(sizes: Column) -> Column:
    """The sum of all sizes before each one. Blocks keep the copies of growing arrays short."""
    block = 256

    def sums(values: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            values, zero,
            lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
            lambda s: s["out"],
        )

    def all_blocks(values: Column) -> Column:
        ends = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))
        return F.transform(ends, lambda b: F.slice(values, b * block + 1, block))

    def whole(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x))
        return let(
            sums(totals, F.lit(0).cast("bigint")),
            lambda first: F.flatten(F.transform(blocks, lambda b, i: sums(b, F.get(first, i)))),
        )

    return let(sizes, lambda v: F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(let(all_blocks(v), whole)))


def matches(text: Column, patterns: list[str], may_hold: Column) -> Column:
    """Leftmost non-overlapping matches: begin (code points from 0), text, and what stands before and after."""
    # \G: each match begins where the last one ended, so the rest of a text is tried once only.
    pattern = F.lit(rf"(?s)\G(.*?)({'|'.join(patterns)})")

    def build(x: Column) -> Column:
        sizes = F.transform(x["gaps"], lambda g, i: (F.char_length(g) + F.char_length(F.get(x["found"], i))).cast("bigint"))
        return let(
            F.struct(running(sizes).alias("at"), F.aggregate(sizes, F.lit(0).cast("bigint"), lambda s, n: s + n).alias("all")),
            lambda y: let(
                F.substring(x["text"], y["all"].cast("int") + 1, F.lit(AFTER)),
                lambda tail: F.transform(x["found"], lambda m, i: F.struct(
                    (F.get(y["at"], i) + F.char_length(F.get(x["gaps"], i))).alias("begin"),
                    m.alias("text"),
                    F.right(F.get(x["gaps"], i), F.lit(BEFORE)).alias("before"),
                    F.left(F.coalesce(F.get(x["gaps"], i + 1), tail), F.lit(AFTER)).alias("after"),
                )),
            ),
        )

    pieces = F.struct(
        text.alias("text"),
        F.regexp_extract_all(text, pattern, F.lit(1)).alias("gaps"),
        F.regexp_extract_all(text, pattern, F.lit(2)).alias("found"),
    )
    none = F.array().cast("array<struct<begin:bigint,text:string,before:string,after:string>>")
    return F.when(may_hold, let(pieces, build)).otherwise(none)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the checksum of card numbers."""
    def add(total: Column, digit: Column) -> Column:
        return total + digit

    doubled = F.transform(F.split(F.reverse(number), ""), lambda c, i: let(
        c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda d: d - F.when(d > 9, 9).otherwise(0)
    ))
    return F.aggregate(doubled, F.lit(0), add) % 10 == 0


def is_base(kind: str, text: Column) -> Column:
    """Whether a match is one of the base pattern and passes its test."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "ip":
        def small(part: Column) -> Column:
            return let(F.ltrim(part, F.lit("0")), lambda p: (F.char_length(p) <= 3) & (
                F.coalesce(F.when(F.char_length(p) <= 3, p).try_cast("int"), F.lit(0)) <= 255
            ))

        return ~F.contains(text, F.lit(":")) & F.forall(F.split(text, r"\."), small)
    number = digits(text)
    if kind == "card":
        return let(number, lambda d: F.when(F.char_length(d).between(16, 19), luhn(d)).otherwise(False))
    return F.startswith(text, F.lit("+")) & F.char_length(number).between(8, 15)


def _vote(yes: Column, no: Column) -> Column:
    """1 for, -1 against, 0 abstains."""
    return F.when(no, F.lit(-1)).when(yes, F.lit(1)).otherwise(F.lit(0))


def _checks(kind: str, text: Column) -> tuple[Column, Column, Column]:
    """The votes of checksum or shape, of the gazetteer, and of the variety of characters."""
    if kind == "email":
        top = F.lower(F.regexp_extract(text, "([A-Za-z0-9-]+)$", 1))
        local = F.lower(F.regexp_extract(text, f"^{_LOCAL}+", 0))
        dull = local.rlike(r"^(?:no-?reply|example|test|user|name|foo|bar)$")
        return (
            let(top.rlike("^[a-z]{2,}$"), lambda ok: _vote(ok, ~ok)),
            let(top.isin(TOP_LEVEL), lambda ok: _vote(ok, ~ok)),
            _vote(local.rlike("[a-z]"), dull),
        )
    if kind == "ip":
        six = F.contains(text, F.lit(":"))
        return (
            _vote(F.lit(True), F.when(six, ~text.rlike("[0-9]")).otherwise(text.rlike(r"(?:^|\.)0[0-9]"))),
            F.when(six, _vote(text.rlike("^[23]"), text.rlike("(?i)^(?:fe80|f[cd])")))
            .otherwise(_vote(F.lit(True), text.rlike(NOT_PUBLIC))),
            _vote(F.lit(True), text.rlike(r"^([0-9])(?:\.\1){3}$|^([0-9A-Fa-f]+)(?::+\2)+$")),
        )
    number = digits(text)
    kinds_of_digits = F.size(F.array_distinct(F.split(number, "")))
    if kind == "card":
        return (
            let(luhn(number), lambda ok: _vote(ok, ~ok)),
            let(number.rlike(ISSUERS), lambda ok: _vote(ok, ~ok)),
            let(kinds_of_digits, lambda n: _vote(n > 3, n < 3)),
        )
    plus = F.startswith(text, F.lit("+"))
    return (
        let(F.char_length(number), lambda n: _vote(n.between(10, 13), (n < 8) | (n > 15))),
        let(text.rlike(CALLING), lambda ok: _vote(plus & ok, plus & ~ok)),
        let(kinds_of_digits, lambda n: _vote(n > 3, n < 3)),
    )


def _judged(kind: str, text: Column, begin: Column, before: Column, after: Column, base: Column) -> Column:
    """A candidate: its place, the votes of all labelers and what else the classifier looks at."""
    check, gazetteer, variety = _checks(kind, text)
    yes, no = CONTEXT[kind]
    near = F.lower(before)
    last = r"\W{0,12}$"
    glued = before.rlike(r"[\p{L}\p{N}_]$") | after.rlike(r"^[\p{L}\p{N}_]")
    traits = [text.rlike(r"[ ()-]"), before.rlike("[:=\"'(\\[]\\s*$"), after.rlike(r"^(?:[\s.,;!?)]|$)")]
    return F.struct(
        F.lit(kind).alias("kind"), begin.alias("begin"), (begin + F.char_length(text)).alias("end"), base.alias("base"),
        F.array(
            F.when(base, F.lit(1)).otherwise(F.lit(0)), check, gazetteer,
            _vote(near.rlike(r"\b" + yes + last), near.rlike(r"\b" + no + last)), _vote(~glued, glued), variety,
        ).alias("votes"),
        F.array(*(F.when(t, 1).otherwise(0) for t in traits)).alias("traits"),
    )


def candidates(text: Column, kind: str) -> Column:
    """All candidates of one kind in a text, in order, none overlapping another."""
    def each(z: Column) -> Column:
        def judged(base: Column) -> Column:
            whole = F.array(_judged(kind, z["text"], z["begin"], z["before"], z["after"], base))
            if kind not in INSIDE:
                return whole
            # Other spellings of phones are candidates as they are; of failed base matches a part may be one.
            own = base | F.lit(kind == "phone") & ~F.startswith(z["text"], F.lit("+"))
            return F.when(own, whole).otherwise(F.transform(matches(z["text"], INSIDE[kind], F.lit(True)), lambda s: _judged(
                kind, s["text"], z["begin"] + s["begin"],
                F.right(F.concat(z["before"], s["before"]), F.lit(BEFORE)),
                F.left(F.concat(s["after"], z["after"]), F.lit(AFTER)), F.lit(False),
            )))

        base = is_base(kind, z["text"])
        if kind == "ip":
            # A base match that fails is no other spelling either.
            return let(base, lambda b: F.when(b | F.contains(z["text"], F.lit(":")), judged(b)).otherwise(
                F.filter(judged(b), lambda _: F.lit(False))
            ))
        return let(base, judged)

    return F.flatten(F.transform(matches(text, ZONES[kind], _may_hold(kind, text)), each))


#: Chances of a vote of -1, 0 and 1 on a real span and on another, before anything is seen, and their weight in examples.
PRIOR = ([0.1, 0.3, 0.6], [0.6, 0.3, 0.1])
PRIOR_WEIGHT = 20.0


def _array(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def _total(rows: Column, fn: Callable[[Column], Column]) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda s, r: s + fn(r))


def _chance(state: Column, votes: Column) -> Column:
    """The chance that a span with these votes is real, if labelers err independently."""
    def product(of: str, first: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(len(VOTERS) - 1)), first,
            lambda p, j: p * F.get(F.get(state[of], j), F.get(votes, j) + 1),
        )

    return let(
        F.struct(product("yes", state["real"]).alias("y"), product("no", 1.0 - state["real"]).alias("n")),
        lambda p: p["y"] / (p["y"] + p["n"]),
    )


def reliabilities(rows: Column, rounds: int) -> Column:
    """Expectation-maximisation over vote patterns with counts: real, and the vote chances yes and no of each labeler."""
    voters = F.sequence(F.lit(0), F.lit(len(VOTERS) - 1))

    def learned(soft: Column, weight: Callable[[Column], Column], prior: list[float]) -> Column:
        def one(total: Column) -> Column:
            return F.transform(voters, lambda j: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda v: (
                _total(soft, lambda r: F.when(F.get(r["votes"], j) == v, weight(r)).otherwise(0.0))
                + F.get(_array(prior), v + 1) * PRIOR_WEIGHT
            ) / (total + PRIOR_WEIGHT)))

        return let(_total(soft, weight), one)

    def again(state: Column, _: Column) -> Column:
        soft = F.transform(rows, lambda r: F.struct(
            r["votes"].alias("votes"), r["n"].alias("n"), (r["n"] * _chance(state, r["votes"])).alias("real")
        ))
        return let(soft, lambda s: F.struct(
            ((_total(s, lambda r: r["real"]) + PRIOR_WEIGHT / 2) / (_total(s, lambda r: r["n"]) + PRIOR_WEIGHT)).alias("real"),
            learned(s, lambda r: r["real"], PRIOR[0]).alias("yes"),
            learned(s, lambda r: r["n"] - r["real"], PRIOR[1]).alias("no"),
        ))

    first = F.struct(
        F.lit(0.5).alias("real"),
        F.transform(voters, lambda _: _array(PRIOR[0])).alias("yes"),
        F.transform(voters, lambda _: _array(PRIOR[1])).alias("no"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, again)


def _inputs(votes: Column, traits: Column) -> Column:
    return F.transform(F.concat(F.array(F.lit(1)), votes, traits), lambda x: x.cast("double"))


def _logistic(weights: Column, inputs: Column) -> Column:
    dot = F.aggregate(F.zip_with(weights, inputs, lambda w, x: w * x), F.lit(0.0), lambda s, x: s + x)
    return let(dot, lambda z: 1.0 / (1.0 + F.exp(-z)))


def classifier(rows: Column, state: Column, steps: int, rate: float = 1.0, decay: float = 1e-3) -> Column:
    """Weights of a logistic regression that learns the labelers' joint chances from votes and traits."""
    n_inputs = 1 + len(VOTERS) + N_TRAITS
    examples = F.transform(rows, lambda r: F.struct(
        _inputs(r["votes"], r["traits"]).alias("x"), r["n"].alias("n"), _chance(state, r["votes"]).alias("y")
    ))

    def train(e: Column) -> Column:
        def step(weights: Column, _: Column) -> Column:
            errors = F.transform(e, lambda r: F.struct(
                r["x"].alias("x"), (r["n"] * (r["y"] - _logistic(weights, r["x"]))).alias("e")
            ))
            return let(errors, lambda g: F.transform(weights, lambda w, j: (
                w + rate * (_total(g, lambda r: r["e"] * F.get(r["x"], j)) / _total(e, lambda r: r["n"]) - decay * w)
            )))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), _array([0.0] * n_inputs), step)

    return let(examples, train)


def learn(found: DataFrame, em_rounds: int = 20, steps: int = 60) -> DataFrame:
    """One row for each kind: kind, state (what labelers are worth) and weights of the classifier.

    Candidates are first counted by votes and traits: at most 3^6 * 2^3 rows a
    kind, whatever the corpus, so only these are gathered.
    """
    spans = found.select(F.explode("__found").alias("s"))
    counts = spans.groupBy("s.kind", "s.votes", "s.traits").agg(F.count("*").cast("double").alias("n"))
    # Sorted, so that sums of doubles come out the same in every run.
    rows = counts.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "traits", "n"))).alias("rows"))
    return rows.select("kind", "rows", reliabilities(F.col("rows"), em_rounds).alias("state")).select(
        "kind", "state", classifier(F.col("rows"), F.col("state"), steps).alias("weights")
    )


def find_pii(
    docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, em_rounds: int = 20, steps: int = 60,
) -> DataFrame:
    """``keep`` (default all columns) and spans: an array of kind, begin, end, base and score.

    Kinds come in the order email, ip, card, phone, spans of a kind by begin;
    places are code points from 0, the end is exclusive. Base spans (the base
    patterns' matches that pass their tests) always stay. Other candidates, other
    spellings and parts of failed matches, stay if the classifier gives them a
    score of 0.5 or more; they overlap no base span of their kind. Six labelers
    vote on each candidate: base pattern, checksum or shape, gazetteer, words
    before it, its borders, variety of its characters. Expectation-maximisation
    estimates how reliable each of them is and how likely each candidate is real;
    a logistic regression on votes and traits learns these chances.

    Null and empty texts have no spans; repeated rows have the same ones. A
    column ``spans`` of the input is replaced. Candidates are stored without
    their texts.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("spans", "__found")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    all_kinds = F.concat(*(candidates(F.col("__text"), kind) for kind in KINDS))
    found = stored(
        docs.withColumn("__text", text).select(*(F.col(f"`{c}`") for c in kept), all_kinds.alias("__found")), "candidates"
    )
    model = learn(found, em_rounds, steps)
    # Four rows at most.
    weights = model.agg(F.map_from_entries(F.collect_list(F.struct("kind", "weights"))).alias("w")).scalar()

    scored = F.transform("__found", lambda s: F.struct(
        s["kind"].alias("kind"), s["begin"].alias("begin"), s["end"].alias("end"), s["base"].alias("base"),
        _logistic(F.element_at(F.col("__weights"), s["kind"]), _inputs(s["votes"], s["traits"])).alias("score"),
    ))
    chosen = F.filter(scored, lambda s: s["base"] | (s["score"] >= 0.5))
    return found.withColumn("__weights", weights).select(*(F.col(f"`{c}`") for c in kept), chosen.alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:begin:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")
