"""Projections, predicates and scalar functions over points: labels, ratios, features, curve codes, crops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraframe.functions.tables import running

GROUND, NOISE, UNCLASSIFIED = (2, 9), (7, 18), (0, 1)
IGNORE_LABEL = 2
BY = ("cloud",)


def map_labels(df: DataFrame, ground=GROUND, ignore=UNCLASSIFIED, col: str = "cls") -> DataFrame:
    """label: 1 ground, 0 other, 2 ignore; ignore wins where the sets overlap."""
    c = F.col(col)
    label = F.when(c.isin(*ground), 1).otherwise(0) if ground else F.lit(0)
    return df.withColumn("label", F.when(c.isin(*ignore), IGNORE_LABEL).otherwise(label) if ignore else label)


def return_ratio(df: DataFrame) -> DataFrame:
    return df.withColumn("ret_ratio", F.col("rnum").cast("double") / F.greatest(F.col("nret"), F.lit(1)))


def log_intensity(df: DataFrame) -> DataFrame:
    return df.withColumn("log_intensity", F.log1p(F.greatest(F.col("intensity"), F.lit(0.0))))


def moments(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """Second-order products of the coordinates over scale."""
    x, y, z = (F.col(c) / F.lit(float(scale)) for c in "xyz")
    return df.withColumns({"m_xx": x * x, "m_yy": y * y, "m_zz": z * z, "m_xy": x * y, "m_xz": x * z, "m_yz": y * z})


@dataclass(frozen=True)
class FeatureSpec:
    """Which channels a feature vector has, in this order; a missing column gives its default."""

    xyz: bool = True
    constant: bool = False
    rgb: bool = False
    mean_elev: bool = False
    curvature: bool = False
    moments: bool = False
    nret: bool = False
    ret_ratio: bool = False
    intensity: bool = False
    height_above: bool = False

    def channels(self) -> list[tuple[str, float]]:
        """(column, default) of each channel."""
        out = [("x", 0.0), ("y", 0.0), ("z", 0.0)] if self.xyz else []
        out += [("", 1.0)] if self.constant else []
        out += [("r", 0.0), ("g", 0.0), ("b", 0.0)] if self.rgb else []
        out += [("mean_elev", 0.0)] if self.mean_elev else []
        out += [("curvature", 0.0)] if self.curvature else []
        out += [(f"m_{a}", 0.0) for a in ("xx", "yy", "zz", "xy", "xz", "yz")] if self.moments else []
        out += [("nret", 1.0)] if self.nret else []
        out += [("ret_ratio", 1.0)] if self.ret_ratio else []
        out += [("log_intensity", 0.0)] if self.intensity else []
        out += [("height_above", 0.0)] if self.height_above else []
        return out or [("", 1.0)]


def feature_dim(spec: FeatureSpec) -> int:
    return len(spec.channels())


def assemble_features(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """features: the channels of spec as one array; colours above 1.5 are taken as bytes, per cloud."""
    have = set(df.columns)
    if spec.rgb and {"r", "g", "b"} <= have:
        top = F.max(F.greatest("r", "g", "b")).over(Window.partitionBy(*BY))
        scale = F.when(top > 1.5, 255.0).otherwise(1.0)
        df = df.withColumns({c: F.col(c) / scale for c in "rgb"})
    value = lambda c, d: F.coalesce(F.col(c).cast("double"), F.lit(d)) if c in have else F.lit(d)
    return df.withColumn("features", F.array(*[value(c, d) for c, d in spec.channels()]))


def standardise(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """(value - mean) / std of each column, if stats (one row: mean, std arrays) has as many; else as they are."""
    wide = df.crossJoin(F.broadcast(stats.select(F.col("mean").alias("_mean"), F.col("std").alias("_std")).limit(1)))
    fits = F.size("_mean") == len(cols)
    return wide.withColumns({c: F.when(fits, (F.col(c) - F.get("_mean", F.lit(i))) / F.get("_std", F.lit(i))).otherwise(F.col(c)) for i, c in enumerate(cols)}).drop("_mean", "_std")


def localise(df: DataFrame, by=BY) -> DataFrame:
    """x, y, z less the cloud's smallest, kept as origin_x, origin_y, origin_z."""
    low = df.groupBy(*by).agg(*[F.min(c).alias(f"origin_{c}") for c in "xyz"])
    return df.join(low, list(by)).withColumns({c: F.col(c) - F.col(f"origin_{c}") for c in "xyz"})


def centre(df: DataFrame, by=BY) -> DataFrame:
    """x, y, z less the cloud's centroid."""
    mid = df.groupBy(*by).agg(*[F.avg(c).alias(f"_{c}") for c in "xyz"])
    return df.join(mid, list(by)).withColumns({c: F.col(c) - F.col(f"_{c}") for c in "xyz"}).drop("_x", "_y", "_z")


def grid_coords(df: DataFrame, dl: float, by=BY) -> DataFrame:
    """gx, gy, gz: voxel indices from the cloud's corner."""
    low = df.groupBy(*by).agg(*[F.min(c).alias(f"_{c}") for c in "xyz"])
    return df.join(low, list(by)).withColumns({f"g{c}": F.floor((F.col(c) - F.col(f"_{c}")) / dl) for c in "xyz"}).drop("_x", "_y", "_z")


def _spread(v: Column, depth: int, place: int) -> Column:
    out = F.lit(0).cast("long")
    for i in range(depth):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1).cast("long")), 3 * i + place))
    return out


def morton_encode(x: Column, y: Column, z: Column, depth: int = 16) -> Column:
    """Bits interleaved, x highest of each three."""
    x, y, z = (c.cast("long") for c in (x, y, z))
    return _spread(x, depth, 2).bitwiseOR(_spread(y, depth, 1)).bitwiseOR(_spread(z, depth, 0))


def morton_decode(code: Column, depth: int = 16) -> tuple[Column, Column, Column]:
    def gather(place: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(depth):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(code, 3 * i + place).bitwiseAND(F.lit(1).cast("long")), i))
        return out

    return gather(2), gather(1), gather(0)


def hilbert_encode(x: Column, y: Column, z: Column, bits: int = 16) -> Column:
    """Position on the 3-D Hilbert curve; bits * 3 <= 63.

    A fold over the bits from the top: an axis whose bit is set inverts the lower bits of x, one whose bit is
    clear exchanges them with x; then the Gray code is undone and the bits are interleaved.
    """
    long = lambda c: c.cast("long")
    s0 = F.struct(long(x).alias("x"), long(y).alias("y"), long(z).alias("z"))

    def step(s: Column, b: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))
        low = bit - 1

        def turn(s: Column, axis: str) -> Column:
            on = s[axis].bitwiseAND(bit) != 0
            swap = s["x"].bitwiseXOR(s[axis]).bitwiseAND(low)
            if axis == "x":
                return F.struct(F.when(on, s["x"].bitwiseXOR(low)).otherwise(s["x"]).alias("x"), s["y"].alias("y"), s["z"].alias("z"))
            parts = {c: s[c] for c in "xyz"}
            parts["x"] = F.when(on, s["x"].bitwiseXOR(low)).otherwise(s["x"].bitwiseXOR(swap))
            parts[axis] = F.when(on, s[axis]).otherwise(s[axis].bitwiseXOR(swap))
            return F.struct(*[v.alias(k) for k, v in parts.items()])

        one = F.transform(F.array(s), lambda t: turn(t, "x"))
        two = F.transform(one, lambda t: turn(t, "y"))
        return F.transform(two, lambda t: turn(t, "z"))[0]

    down = F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)) if bits > 1 else F.array().cast("array<int>")
    turned = F.aggregate(down, s0, step)
    gray = F.transform(F.array(turned), lambda s: F.struct(s["x"].alias("x"), s["y"].bitwiseXOR(s["x"]).alias("y"), s["z"].bitwiseXOR(s["y"]).bitwiseXOR(s["x"]).alias("z")))
    flip = lambda s: F.aggregate(down, F.lit(0).cast("long"), lambda t, b: F.when(s["z"].bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))) != 0, t.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int")) - 1)).otherwise(t))
    done = F.transform(gray, lambda s: F.transform(F.array(flip(s)), lambda t: F.struct(s["x"].bitwiseXOR(t).alias("x"), s["y"].bitwiseXOR(t).alias("y"), s["z"].bitwiseXOR(t).alias("z")))[0])
    every = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    take = lambda s, c, b: F.call_function("shiftright", s[c], b.cast("int")).bitwiseAND(F.lit(1).cast("long"))
    key = F.transform(done, lambda s: F.aggregate(every, F.lit(0).cast("long"), lambda k, b: F.shiftleft(k, 3).bitwiseOR(F.shiftleft(take(s, "x", b), 2)).bitwiseOR(F.shiftleft(take(s, "y", b), 1)).bitwiseOR(take(s, "z", b))))
    return key[0]


def hilbert_decode(code: Column, bits: int = 16) -> Column:
    """The struct (x, y, z) whose position on the curve is code: hilbert_encode backwards.

    The bits are dealt to the axes, the Gray code is made again, and the turns are undone from the lowest bit up.
    """
    one = F.lit(1).cast("long")
    bit_of = lambda b: F.call_function("shiftleft", one, b.cast("int"))
    every = F.sequence(F.lit(0), F.lit(bits - 1))

    def gather(place: int) -> Column:
        return F.aggregate(every, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.call_function("shiftleft", F.call_function("shiftright", code, (3 * b + place).cast("int")).bitwiseAND(one), b.cast("int"))))

    dealt = F.transform(F.array(F.struct(gather(2).alias("x"), gather(1).alias("y"), gather(0).alias("z"))), lambda s: F.struct(
        s["x"].bitwiseXOR(F.shiftright(s["z"], 1)).alias("x"), s["y"].bitwiseXOR(s["x"]).alias("y"), s["z"].bitwiseXOR(s["y"]).alias("z"),
    ))

    def turn(s: Column, axis: str, bit: Column) -> Column:
        on, low = s[axis].bitwiseAND(bit) != 0, bit - 1
        swap = s["x"].bitwiseXOR(s[axis]).bitwiseAND(low)
        parts = {c: s[c] for c in "xyz"}
        parts["x"] = F.when(on, s["x"].bitwiseXOR(low)).otherwise(s["x"].bitwiseXOR(swap))
        if axis != "x":
            parts[axis] = F.when(on, s[axis]).otherwise(s[axis].bitwiseXOR(swap))
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    def step(s: Column, b: Column) -> Column:
        z = F.transform(F.array(s), lambda t: turn(t, "z", bit_of(b)))
        y = F.transform(z, lambda t: turn(t, "y", bit_of(b)))
        return F.transform(y, lambda t: turn(t, "x", bit_of(b)))[0]

    up = F.sequence(F.lit(1), F.lit(bits - 1)) if bits > 1 else F.array().cast("array<int>")
    return F.transform(dealt, lambda s: F.aggregate(up, s, step))[0]


ORDERS = {"z": "xyz", "z-trans": "yxz", "hilbert": "xyz", "hilbert-trans": "yxz", "hilbert-yzx": "yzx", "hilbert-zxy": "zxy"}


def serialize(df: DataFrame, orders=("z", "z-trans"), depth: int = 16) -> DataFrame:
    """code_<order> for each order, from the voxel indices gx, gy, gz."""
    code = lambda o: (morton_encode if o.startswith("z") else hilbert_encode)(*[F.col(f"g{a}") for a in ORDERS[o]], depth)
    return df.withColumns({f"code_{o.replace('-', '_')}": code(o) for o in orders})


def order_rank(df: DataFrame, code: str, by=BY) -> DataFrame:
    """rank_<code>: place in curve order within the cloud, from 0."""
    name = f"rank_{code}"
    return running(df.drop(name), by, [code, "pid"], "ranks", **{name: F.lit(1).cast("long")}).drop(f"{name}_all")


def order_variants(df: DataFrame, rank: str, by=BY) -> DataFrame:
    """rank reversed, stride-2 interleaved (evens then odds), and that reversed; each a permutation of the cloud's ranks."""
    n, r = F.col("_n"), F.col(rank)
    half = F.floor((n + 1) / 2)
    inter = F.when(r % 2 == 0, F.floor(r / 2)).otherwise(half + F.floor(r / 2))
    sized = df.join(df.groupBy(*by).agg(F.count("*").alias("_n")), list(by))
    return sized.withColumns({"rank_reversed": n - 1 - r, "rank_stride": inter, "rank_stride_reversed": n - 1 - inter}).drop("_n")


def window_encoding(df: DataFrame, w: int = 16) -> DataFrame:
    """Window position of grid cells, for windows at shift 0 and w/2: z/32, window x and y over 64, place inside."""
    cols = {"we_z": F.col("gz") / 32}
    for name, shift in (("0", 0), ("1", w // 2)):
        for axis in "xy":
            v = F.col(f"g{axis}") + shift
            cols[f"we{name}_{axis}"] = F.floor(v / w) / 64
            cols[f"we{name}_in_{axis}"] = F.pmod(v, F.lit(w)) / w
    return df.withColumns(cols)


def pack_key(df: DataFrame, by=BY) -> DataFrame:
    """packed: mixed-radix key of the cloud's ordinal and the grid cell, after subtracting the smallest cell."""
    ends = df.agg(*[F.min(f"g{c}").alias(f"_lo{c}") for c in "xyz"], *[(F.max(f"g{c}") - F.min(f"g{c}") + 1).alias(f"_n{c}") for c in "xyz"])
    clouds = df.select(*by).distinct()
    ordinal = clouds.withColumn("_b", (F.row_number().over(Window.orderBy(*by)) - 1).cast("long"))
    wide = df.join(ordinal, list(by)).crossJoin(F.broadcast(ends))
    key = F.col("_b")
    for c in "xyz":
        key = key * F.col(f"_n{c}") + (F.col(f"g{c}") - F.col(f"_lo{c}"))
    return wide.withColumn("packed", key).drop("_b", *[f"_{k}{c}" for k in ("lo", "n") for c in "xyz"])


def crop_window(df: DataFrame, side: float, cx: float | None = None, cy: float | None = None, closed: bool = False) -> DataFrame:
    """Points in a square about (cx, cy), by default the centroid of all; half-open, or closed on both sides."""
    half = side / 2
    if cx is None or cy is None:
        mid = df.agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
        df = df.crossJoin(F.broadcast(mid))
        a, b = F.col("_cx"), F.col("_cy")
    else:
        a, b = F.lit(float(cx)), F.lit(float(cy))
    inside = (F.col("x") >= a - half) & (F.col("y") >= b - half)
    inside &= ((F.col("x") <= a + half) & (F.col("y") <= b + half)) if closed else ((F.col("x") < a + half) & (F.col("y") < b + half))
    return df.filter(inside).drop("_cx", "_cy")


def squash(v: Column, lo: float, hi: float) -> Column:
    return F.lit(float(lo)) + (hi - lo) / (1 + F.exp(-v))


def clip(v: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi)))


def nice_round(v: Column) -> Column:
    """The largest of 1, 2, 5 times a power of ten not above v; 1 for v <= 0."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(v)))
    m = v / power
    return F.when(v <= 0, 1.0).otherwise(power * F.when(m >= 5, 5.0).when(m >= 2, 2.0).otherwise(1.0))
