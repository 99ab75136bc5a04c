"""Tools that answer with a result or an error."""
from __future__ import annotations

import math
import operator
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that an expression may use. Logarithms are natural, or of the base that is given.
NAMES = {"pi": math.pi, "e": math.e}
FUNCTIONS = {f: getattr(math, f) for f in ("sqrt", "sin", "cos", "tan", "asin", "acos", "atan", "exp", "floor", "ceil")} | {"abs": abs}
#: What a failing tool tells, with the input between. Fixed values.
NOT_MATH, NO_PLACE, NO_SERVICE = 'Couldn\'t evaluate "%s". Is it valid math?', 'Couldn\'t find "%s". Check the spelling?', "Weather service is unavailable right now."
_TOKEN = re.compile(r"\s*(?:((?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|([A-Za-z]\w*)|([-+*/%^(),]))")
#: How tightly operators bind; a sign binds more loosely than a power, and a power's exponent may have one.
_BINDS = {"+": 1, "-": 1, "*": 2, "/": 2, "%": 2, "sign": 3, "^": 4}


def _divided(a: float, b: float) -> float:
    if b:
        return a / b
    return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)


def _modulo(a: float, b: float) -> float:
    """The rest has the sign of the divisor; a divisor of 0 leaves the dividend."""
    return a - b * math.floor(a / b) if b else a


def _power(a: float, b: float) -> float:
    if a == 0 and b < 0:
        return math.inf
    try:
        return math.pow(a, b)
    except OverflowError:
        return -math.inf if a < 0 and b % 2 == 1 else math.inf


def _log(x: float, base: float | None = None) -> float:
    own = -math.inf if x == 0 else math.log(x)
    return own if base is None else _divided(own, -math.inf if base == 0 else math.log(base))


_BINARY = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": _divided, "%": _modulo, "^": _power}
_CALLS = {name: (f, (1,)) for name, f in FUNCTIONS.items()} | {"log": (_log, (1, 2)), "log10": (lambda x: _log(x) if x == 0 else math.log10(x), (1,)), "log2": (lambda x: _log(x) if x == 0 else math.log2(x), (1,))}


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError("not in the grammar")
        out.append((("number", "name", "mark")[m.lastindex - 1], m[m.lastindex]))
        at = m.end()
    return out


def _value(tokens: list[tuple[str, str]]) -> float:
    """Operator precedence with two stacks, so that neither length nor depth of an expression has a limit. Marks on the
    stack: operators, "sign", "(" and the names of functions below their "("."""
    values: list[float] = []
    marks: list[str] = []
    counts: list[int] = []  # arguments of each open parenthesis
    operand = True  # an operand has to come next

    def apply() -> None:
        mark = marks.pop()
        b = values.pop()
        values.append(-b if mark == "sign" else float(_BINARY[mark](values.pop(), b)))

    def apply_to_parenthesis() -> None:
        while marks and marks[-1] != "(":
            apply()
        if not marks:
            raise ValueError("parenthesis")

    for k, (kind, token) in enumerate(tokens):
        if operand:
            if kind == "number":
                values.append(float(token))
                operand = False
            elif kind == "name" and token in _CALLS and tokens[k + 1 : k + 2] == [("mark", "(")]:
                marks.append(token)
            elif kind == "name" and token in NAMES:
                values.append(NAMES[token])
                operand = False
            elif token == "(":
                marks.append("(")
                counts.append(1)
            elif token in "+-":
                if token == "-":
                    marks.append("sign")
            else:
                raise ValueError("operand")
        elif kind != "mark" or token == "(":
            raise ValueError("operator")
        elif token == ",":
            apply_to_parenthesis()
            counts[-1] += 1
            operand = True
        elif token == ")":
            apply_to_parenthesis()
            marks.pop()
            n = counts.pop()
            if marks and marks[-1] in _CALLS:
                f, allowed = _CALLS[marks.pop()]
                if n not in allowed:
                    raise ValueError("arguments")
                values[-n:] = [float(f(*values[-n:]))]
            elif n > 1:
                raise ValueError("arguments")
        else:
            while marks and marks[-1] in _BINDS and (_BINDS[marks[-1]] > _BINDS[token] or _BINDS[marks[-1]] == _BINDS[token] and token != "^"):
                apply()
            marks.append(token)
            operand = True
    if operand:
        raise ValueError("operand")
    while marks:
        if marks[-1] not in _BINDS:
            raise ValueError("parenthesis")
        apply()
    return values[0]


def calculate(expression: str | None) -> float | None:
    """The value of numbers, + - * / % ^, parentheses, pi, e and common functions; None if it is anything else or has no
    real value. Numbers are doubles: what grows beyond them, or is divided by 0, is infinite."""
    if expression is None:
        return None
    try:
        return _value(_tokens(expression))
    except (ValueError, ArithmeticError):
        return None


def _told(pattern: str, what: Column) -> Column:
    return F.format_string(pattern, F.coalesce(what, F.lit("")))


def calculated(rows: DataFrame, expression: str = "expression") -> DataFrame:
    """rows with result, or error where the expression cannot be evaluated. A batch evaluates an expression once. What has
    a value that is not a number, such as 0 / 0, has neither."""

    @F.pandas_udf("struct<ok:boolean,result:double>")
    def evaluated(x: pd.Series) -> pd.DataFrame:
        known = {e: calculate(e) for e in x.dropna().unique()}
        got = [known.get(e) if isinstance(e, str) else None for e in x]
        return pd.DataFrame({"ok": [v is not None for v in got], "result": pd.Series(got, dtype="float64")})

    out = rows.withColumn("_got", evaluated(F.col(expression)))
    out = out.withColumn("result", F.when(F.col("_got.ok"), F.col("_got.result")))
    return out.withColumn("error", F.when(~F.col("_got.ok"), _told(NOT_MATH, F.col(expression)))).drop("_got")


def enriched(requests: DataFrame, places: DataFrame, weather: DataFrame, location: str = "location") -> DataFrame:
    """requests with place, temperature, code, or error: first the place of that name (the first by rank), then its
    weather. places (name, country, rank, place_id), weather (place_id, temperature, code)."""
    first = places.groupBy("name").agg(F.min_by(F.struct("place_id", "country"), "rank").alias("p"))
    first = first.select(F.col("name").alias("_name"), F.col("p.place_id").alias("_place"), F.col("p.country").alias("_country"))
    now = weather.select(F.col("place_id").alias("_at"), "temperature", F.col("code").alias("weather_code"))
    rows = requests.join(first, F.col(location) == F.col("_name"), "left").join(now, F.col("_place") == F.col("_at"), "left")
    error = F.when(F.col("_name").isNull(), _told(NO_PLACE, F.col(location))).when(F.col("_at").isNull(), NO_SERVICE)
    place = F.when(F.col("_at").isNotNull(), F.concat(F.col("_name"), F.lit(", "), F.col("_country")))
    return rows.withColumn("place", place).withColumn("unit", F.when(F.col("_at").isNotNull(), F.lit("°C"))).withColumn("error", error).drop("_name", "_place", "_country", "_at")


def register(spark) -> dict[str, object]:
    """The tools by name; calc can also be called in SQL."""

    @F.pandas_udf("double")
    def calc(x: pd.Series) -> pd.Series:
        return x.map(calculate).astype("float64")

    spark.udf.register("calc", calc)
    return {"calc": calculated, "weather": enriched}


def bounded_steps(state: DataFrame, step, most: int = 5) -> DataFrame:
    """The state after at most ``most`` steps; step(state, k) gives the next state, or None to stop."""
    for k in range(most):
        after = step(state, k)
        if after is None:
            break
        state = after
    return state
