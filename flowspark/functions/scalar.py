"""Scalar, string, array and JSON expressions. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.contract import CLIP_LIMIT, SIGMOID_CLIP


def c(name: str) -> Column:
    """Column by exact name; contract names hold dots, blanks and slashes."""
    return F.col(f"`{name}`")


def quoted(name: str) -> str:
    """Column name as SQL text."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """String literal as SQL text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_finite(name: str) -> str:
    """SQL text: the column as DOUBLE, NULL where it is NaN or infinite.

    Wide tables use SQL text: one expression per column instead of a tree of calls.
    """
    v = f"CAST({quoted(name)} AS DOUBLE)"
    return f"CASE WHEN NOT isnan({v}) AND abs({v}) < double('Infinity') THEN {v} END"


def sql_clean(name: str, limit: float | None = CLIP_LIMIT) -> str:
    """SQL text: non-finite to NULL first, then clip, so an infinity never becomes the limit."""
    if limit is None:
        return sql_finite(name)
    v = f"CAST({quoted(name)} AS DOUBLE)"
    return (f"CASE WHEN NOT isnan({v}) AND abs({v}) < double('Infinity') "
            f"THEN greatest({-limit!r}D, least({limit!r}D, {v})) END")


def replace_columns(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Replace columns in place by SQL text, in one projection."""
    return df.selectExpr(*[f"{exprs[x]} AS {quoted(x)}" if x in exprs else quoted(x)
                           for x in df.columns])


def safe_div(a: Column, b: Column) -> Column:
    """``a / b``, 0 where the denominator is 0 or either side is missing."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def safe_stat(stat: Column) -> Column:
    """Statistic of a possibly empty group: 0 instead of NULL."""
    return F.coalesce(stat.cast("double"), F.lit(0.0))


def is_nonfinite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def finite_or_null(x: Column) -> Column:
    """NaN and both infinities become NULL."""
    x = x.cast("double")
    return F.when(~is_nonfinite(x), x)


def clip(x: Column, limit: float = CLIP_LIMIT) -> Column:
    """Clamp to ``[-limit, limit]``; NULL stays NULL (least/greatest skip NULLs)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))


def finite_or_zero(x: Column) -> Column:
    return F.coalesce(finite_or_null(x), F.lit(0.0))


def sigmoid(z: Column) -> Column:
    """Logistic function of a bounded argument; NULL and NaN give NULL, never a probability."""
    bounded = F.greatest(F.lit(-SIGMOID_CLIP), F.least(F.lit(SIGMOID_CLIP), z))
    return F.when(z.isNotNull() & ~F.isnan(z), F.lit(1.0) / (F.lit(1.0) + F.exp(-bounded)))


def relu(z: Column) -> Column:
    """Positive part; NULL stays NULL (greatest skips NULLs)."""
    return F.when(z.isNotNull(), F.greatest(F.lit(0.0), z))


def array_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0),
                       lambda acc, v: acc + v)


def dense(x: Column, weights: Sequence[Sequence[float]], bias: Sequence[float],
          activation=None) -> Column:
    """One fully connected layer on an array column; ``weights[j]`` feeds output unit j."""
    act = activation or (lambda z: z)
    units = F.array(*[F.struct(array_literal(w).alias("w"), F.lit(float(b)).alias("b"))
                      for w, b in zip(weights, bias)])
    return F.transform(units, lambda u: act(dot(x, u["w"]) + u["b"]))


def argmax(a: Column) -> Column:
    """Index of the largest element, the first one on ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def is_attack_label(label: Column) -> Column:
    """1 unless the trimmed label is BENIGN; a missing label reads as text ``nan``, so 1."""
    text = F.upper(F.trim(F.coalesce(label.cast("string"), F.lit("nan"))))
    return (text != "BENIGN").cast("int")


def canonical_label(label: Column) -> Column:
    """All web attack variants share one class name."""
    return F.regexp_replace(label, "^Web Attack.*", "WebAttack")


def flag_set(flags: Column, bit: int) -> Column:
    """Whether a TCP flag bit is set; NULL flags (not TCP) count as unset."""
    return F.coalesce(flags.bitwiseAND(F.lit(bit)) != 0, F.lit(False))


def valid_ip_text(ip: Column) -> Column:
    return F.coalesce((F.trim(ip) != "") & (F.lower(F.trim(ip)) != "nan"), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as BIGINT, NULL if the text is not an IPv4 address."""
    parts = F.split(ip, r"\.")
    quad = r"^(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}$"
    total = F.lit(0).cast("bigint")
    for i in range(4):
        total = total * 256 + F.element_at(parts, i + 1).cast("bigint")
    return F.when(ip.rlike(quad), total)


def ipv4_in_network(ip: Column, network: str) -> Column:
    """Whether an IPv4 address lies in ``a.b.c.d/n``; False for anything else."""
    base, bits = network.split("/")
    number = 0
    for octet in base.split("."):
        number = number * 256 + int(octet)
    shift = 32 - int(bits)
    return F.coalesce(F.shiftright(ipv4_number(ip), shift) == F.lit(number >> shift).cast("bigint"),
                      F.lit(False))


def flow_id(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column,
            proto: Column) -> Column:
    return F.concat_ws("-", src_ip, dst_ip, src_port.cast("string"), dst_port.cast("string"),
                       proto.cast("string"))


def start_time_text(ts_us: Column) -> Column:
    """Second-resolution start time in the session zone."""
    return F.date_format(F.timestamp_micros(ts_us), "yyyy-MM-dd HH:mm:ss")


def block_command(ip: Column) -> Column:
    """Firewall command as text. Nothing in this library runs it."""
    return F.concat(F.lit("sudo iptables -A INPUT -s "), ip, F.lit(" -j DROP"))


def json_record(**fields: Column) -> Column:
    """One JSON object; NULL fields are left out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def epoch_seconds(ts: Column | None = None) -> Column:
    """Log time in whole seconds; the current time unless ``ts`` is given."""
    return F.unix_timestamp() if ts is None else F.unix_timestamp(ts)


def log_floor(p: Column, floor: float = -100.0) -> Column:
    """Natural log bounded below, so a hard 0 or 1 has a finite loss."""
    return F.when(p > 0, F.greatest(F.lit(floor), F.ln(p))).otherwise(F.lit(floor))
