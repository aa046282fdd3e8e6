"""What the versions of the FCS standard ask of keywords, as a table of rules that
Spark evaluates over maps of keywords: for one file or for millions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Keywords that every data set must have, by the first and last version that asks for them.
REQUIRED = {
    "$BYTEORD": (2.0, 9), "$DATATYPE": (2.0, 9), "$NEXTDATA": (2.0, 9), "$PAR": (2.0, 9), "$TOT": (2.0, 9), "$MODE": (2.0, 3.1),
    "$BEGINDATA": (3.0, 9), "$ENDDATA": (3.0, 9), "$BEGINSTEXT": (3.0, 3.1), "$ENDSTEXT": (3.0, 3.1), "$BEGINANALYSIS": (3.0, 3.1), "$ENDANALYSIS": (3.0, 3.1), "$CYT": (3.2, 9),
}


class Text(NamedTuple):
    """The keywords of a data set: as a map, and as pairs as they stand in the file."""

    keys: Column
    pairs: Column
    delimiter: Column
    version: Column
    names: Column  #: of all keywords
    kind: Column  #: $DATATYPE
    rows: Column  #: $TOT, a number
    parameters: Column  #: $PAR, a number

    def __call__(self, key: str | Column) -> Column:
        return F.try_element_at(self.keys, F.lit(key) if isinstance(key, str) else key)


class Rule(NamedTuple):
    """``wrong`` holds where a keyword breaks the rule in versions ``since`` to ``until``."""

    keyword: str
    problem: str
    wrong: Callable[[Text], Column]
    since: float = 2.0
    until: float = 9.0


def _other(key: str, *allowed: str) -> Callable[[Text], Column]:
    return lambda t: t(key).isNotNull() & ~t(key).isin(*allowed)


#: Rules of a data set as a whole.
WHOLE = (
    *(Rule(k, "missing", lambda t, k=k: t(k).isNull(), a, b) for k, (a, b) in REQUIRED.items()),
    Rule("$DATATYPE", "unknown", _other("$DATATYPE", "A", "I", "F", "D")),
    Rule("$DATATYPE", "deprecated", lambda t: t.kind == "A", 3.1),
    Rule("$MODE", "unknown", _other("$MODE", "L", "C", "U"), 2.0, 3.1),
    Rule("$MODE", "deprecated", lambda t: t("$MODE").isin("C", "U"), 2.0, 3.1),
    Rule("$MODE", "deprecated", lambda t: t("$MODE").isNotNull(), 3.2),
    Rule("$MODE", "unknown", _other("$MODE", "L"), 3.2),
    Rule("$BYTEORD", "unknown", _other("$BYTEORD", "1,2,3,4", "4,3,2,1"), 3.1),
    Rule("$TOT", "is 0", lambda t: t.rows == 0),
    Rule("$PAR", "is 0", lambda t: t.parameters == 0),
    Rule("$PnN", "not as many as $PAR", lambda t: F.size(F.filter(t.names, lambda k: k.rlike(r"^\$P\d+N$"))) != t.parameters, 3.0),
)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with ``value`` computed once however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _number(value: Column) -> Column:
    return F.when(value.rlike(NUMBER), value.try_cast("double"))


def _two(value: Column) -> Column:
    """The two numbers of an amplification; null if it isn't that."""
    parts = F.transform(F.split(value, ","), lambda x: _number(F.trim(x)))
    return _let(parts, lambda x: F.when((F.size(x) == 2) & F.forall(x, lambda v: v.isNotNull()), x))


#: Keywords ($Pn and these letters) that rules of a parameter look at, and those read as numbers.
LETTERS, NUMBERS = ("B", "R", "N", "E", "G", "DATATYPE"), ("B", "R", "G")


def _values(t: Text, i: Column) -> Column:
    """What the rules of parameter ``i`` look at: prefix ($Pn), the letters' values, kind (its type)."""
    prefix = F.concat(F.lit("$P"), i.cast("string"))
    return _let(prefix, lambda p: F.struct(p.alias("prefix"), *(t(F.concat(p, F.lit(k))).alias(k) for k in LETTERS)))


def _read(t: Text, s: Column) -> Column:
    """``_values`` with numbers (n_B, ...), the amplification (two) and whether that is linear (null if there is none)."""
    kind = F.when(t.version >= 3.15, F.coalesce(s["DATATYPE"], t.kind)).otherwise(t.kind)
    numbers = [_number(s[k]).alias(f"n_{k}") for k in NUMBERS]
    linear = lambda two: F.aggregate(two, F.lit(True), lambda a, x: a & (x == 0))
    return _let(_two(s["E"]), lambda two: F.struct(s["prefix"].alias("prefix"), *(s[k].alias(k) for k in LETTERS), kind.alias("kind"), *numbers, two.alias("two"), linear(two).alias("linear")))


class Parameter(NamedTuple):
    """``wrong`` takes the keywords and what ``_read`` gives of the parameter."""

    letter: str
    problem: str
    wrong: Callable[[Text, Column], Column]
    since: float = 2.0
    until: float = 9.0


#: Rules of each parameter.
EACH = (
    Parameter("B", "missing", lambda t, s: s["B"].isNull()),
    Parameter("R", "missing", lambda t, s: s["R"].isNull()),
    Parameter("N", "missing", lambda t, s: s["N"].isNull(), 3.0),
    Parameter("E", "missing", lambda t, s: s["E"].isNull(), 3.0),
    Parameter("DATATYPE", "unknown", lambda t, s: s["DATATYPE"].isNotNull() & ~s["DATATYPE"].isin("I", "F", "D"), 3.2),
    Parameter("B", "no number", lambda t, s: s["B"].isNotNull() & s["n_B"].isNull() & ~((s["B"] == "*") & (t.kind == "A"))),
    Parameter("B", "not divisible by 8", lambda t, s: (s["n_B"] % 8 != 0) & (t.kind != "A"), 3.2),
    Parameter("B", "must be 32 for floats", lambda t, s: (s["kind"] == "F") & (s["n_B"] != 32), 3.1),
    Parameter("B", "must be 64 for doubles", lambda t, s: (s["kind"] == "D") & (s["n_B"] != 64), 3.1),
    Parameter("R", "no number", lambda t, s: s["R"].isNotNull() & s["n_R"].isNull()),
    Parameter("N", "has a comma", lambda t, s: F.contains(s["N"], F.lit(",")), 3.1),
    Parameter("E", "not two numbers", lambda t, s: s["E"].isNotNull() & s["two"].isNull()),
    Parameter("E", "must be 0,0 for floating point data", lambda t, s: s["kind"].isin("F", "D") & ~s["linear"], 3.1),
    Parameter("E", "one number is 0", lambda t, s: F.exists(s["two"], lambda x: x == 0) & ~s["linear"]),
    Parameter("G", "no number", lambda t, s: s["G"].isNotNull() & s["n_G"].isNull()),
    Parameter("G", "not above 0", lambda t, s: s["n_G"] <= 0),
    Parameter("G", "is for integers only", lambda t, s: s["n_G"].isNotNull() & (s["kind"] != "I"), 3.2),
    Parameter("G", "with logarithmic amplification", lambda t, s: (s["n_G"] != 1) & ~s["linear"]),
)


def _told(keyword: Column, problem: str) -> Column:
    return F.struct(keyword.alias("keyword"), F.lit(problem).alias("problem"))


def _found(t: Text, rule: Rule | Parameter, wrong: Column, keyword: Column) -> Column:
    applies = t.version.between(rule.since - 0.05, rule.until + 0.05)
    return F.when(applies & F.coalesce(wrong, F.lit(False)), _told(keyword, rule.problem))


def _repeated(keywords: Column, problem: str) -> Column:
    """Keywords that an array holds more than once."""
    more = F.filter(F.array_distinct(keywords), lambda v: F.size(F.filter(keywords, lambda x: x == v)) > 1)
    return F.transform(more, lambda v: _told(v, problem))


def _spillover(value: Column) -> Column:
    """The names of a spillover matrix, or null if its size isn't right."""
    parts = F.split(value, ",")
    n = F.element_at(parts, 1).try_cast("int")
    return F.when((n > 0) & (F.size(parts) == 1 + n + n * n), F.slice(parts, F.lit(2), n))


def problems(keys: Column, pairs: Column | None = None, delimiter: Column | None = None) -> Column:
    """Array of (keyword, problem) of a map of keywords with its $VERSION ("FCS3.1").

    ``pairs`` (keyword, value as they stand in the file) tell repeated keywords and
    padded numbers, ``delimiter`` keywords and values that begin with it.

    What several rules ask for (version, numbers, values of a parameter) is bound to a
    name first: Spark computes an argument of a lambda function once, but repeats
    what stands several times inside of one."""
    none = F.array().cast("array<struct<keyword:string,value:string>>")
    pairs, delimiter = none if pairs is None else pairs, F.lit("") if delimiter is None else delimiter

    def bound(given: Column) -> Column:
        get = lambda key: F.try_element_at(given["keys"], F.lit(key))
        version = F.coalesce(F.regexp_extract(get("$VERSION"), r"(\d\.\d)", 1).try_cast("double"), F.lit(3.1))
        facts = {"keys": given["keys"], "pairs": given["pairs"], "delimiter": given["delimiter"], "version": version, "names": F.map_keys(given["keys"]), "kind": get("$DATATYPE"), "rows": _let(get("$TOT"), _number), "parameters": _let(get("$PAR"), _number)}
        return _let(F.struct(*(v.alias(k) for k, v in facts.items())), lambda x: _problems(Text(*(x[k] for k in Text._fields))))

    return _let(F.struct(keys.alias("keys"), pairs.alias("pairs"), delimiter.alias("delimiter")), bound)


def _problems(t: Text) -> Column:
    n = F.greatest(F.least(F.coalesce(t.parameters.cast("int"), F.lit(0)), F.size(t.pairs) + F.size(t.names)), F.lit(0))
    values = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i > 0), lambda i: _values(t, i))
    whole = F.array(*(_found(t, r, r.wrong(t), F.lit(r.keyword)) for r in WHOLE))
    return F.filter(F.concat(whole, _let(values, lambda v: _of_parameters(t, v))), lambda x: x.isNotNull())


def _of_parameters(t: Text, values: Column) -> Column:
    """Problems of all parameters, of their names, and of the keywords as they stand; ``values``: ``_values`` of each."""
    rules = lambda s: F.array(*(_found(t, r, r.wrong(t, s), F.concat(s["prefix"], F.lit(r.letter))) for r in EACH))
    each = F.flatten(F.transform(F.transform(values, lambda s: _read(t, s)), rules))

    def of_names(names: Column) -> Column:
        twice = F.when(F.size(F.array_distinct(names)) < F.size(names), _told(F.lit("$PnN"), "names repeat"))
        text = t("$SPILLOVER")
        spill = _let(_spillover(text), lambda m: F.when(text.isNotNull() & m.isNull(), _told(F.lit("$SPILLOVER"), "no matrix")).when(F.size(F.array_except(m, names)) > 0, _told(F.lit("$SPILLOVER"), "unknown parameter")))
        return F.concat(F.array(twice), _as_they_stand(t), F.array(spill))

    names = F.filter(F.transform(values, lambda s: s["N"]), lambda x: x.isNotNull())
    return F.concat(each, _let(names, of_names))


def _as_they_stand(t: Text) -> Column:
    """Problems of keywords and values as strings, whatever they mean."""
    empty = F.transform(F.filter(F.map_entries(t.keys), lambda e: e["value"] == ""), lambda e: _told(e["key"], "empty"))
    bad = lambda k: F.when(t.version >= 2.95, k.rlike(r"[^\x20-\xFE]")).otherwise(k.rlike(r"[\n\r]"))
    odd = F.transform(F.filter(t.names, bad), lambda k: _told(k, "bad character in the name"))
    padded = F.transform(F.filter(t.pairs, lambda x: F.trim(x["value"]).rlike(NUMBER) & (F.trim(x["value"]) != x["value"])), lambda x: _told(F.trim(x["keyword"]), "number padded with other than 0"))
    begins = F.transform(F.filter(t.pairs, lambda x: (t.delimiter != "") & (F.startswith(x["keyword"], t.delimiter) | F.startswith(x["value"], t.delimiter))), lambda x: _told(F.trim(x["keyword"]), "begins with the delimiter"))
    again = _let(F.transform(t.pairs, lambda x: F.trim(x["keyword"])), lambda v: _repeated(v, "repeated"))
    return F.concat(empty, odd, padded, begins, again)
