"""Joins of points with the points near them, in any number of dimensions: the table of nearest neighbours, and DBSCAN.

Points go to the nearest of a few pivots and, where a pivot has many, to rings about it. Small groups are bundled, a large one is a bundle of several units; a unit is
what one task holds, of bounded size. By the triangle inequality a point at d from a pivot has at least d - high and low - d, and at most d + high, to the members
of a ring from low to high. So a point visits only the bundles that may hold what it looks for, and a bundle that lies within reach as a whole
is counted without a visit. Visitors stream past a unit; they are never held together, and pairs are never written.

The pivots grow with the square root of the points up to PIVOTS. They and the bundles (PIVOTS * RINGS at most) are all that the driver holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.operators.graph import components
from assaylake.sources.scratch import written

#: Pairs whose distances are computed in double precision at a time.
SOME = 1 << 16
#: Pivots and rings about each at most, points of a unit, numbers in a matrix of distances, numbers of visitors that a task sends at a time, rounding that bounds allow for.
PIVOTS, RINGS, UNIT, CELLS, SENT, SLACK = 1024, 8, 16384, 1 << 21, 1 << 19, 1e-9


def vector_of(df: DataFrame, columns: list[str]) -> Column:
    """The columns as one vector; a single array column is one already."""
    if len(columns) == 1 and dict(df.dtypes)[columns[0]].startswith("array"):
        return F.col(columns[0]).cast("array<double>")
    return F.array(*(F.col(c).cast("double") for c in columns))


def points(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, vector) of the rows with a key and a finite number in each column."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = df.select(F.col(key).alias("key"), vector_of(df, columns).alias("vector"))
    return rows.where(F.col("key").isNotNull() & F.coalesce((F.size("vector") > 0) & ~F.exists("vector", bad), F.lit(False)))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product, rounded."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def rounding(a: np.ndarray, b: np.ndarray) -> float:
    """More than squares() may be off."""
    return 1e-12 * (1 + float(np.abs(a).max(initial=0)) + float(np.abs(b).max(initial=0))) ** 2 * a.shape[1]


def _longest(rows: np.ndarray) -> float:
    return math.sqrt(float((rows * rows).sum(1).max(initial=0)))


class Held:
    """Rows that many others are held against: single precision says which distances need double precision."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.longest = rows, _longest(rows)
        with np.errstate(over="ignore"):  # then they are not used
            self.short = rows.astype("f4")
            self.squares = (self.short * self.short).sum(1)

    def near(self, part: np.ndarray) -> tuple[np.ndarray, float]:
        """(rows of part, rows held): squared distances, and more than they are off."""
        norm = self.longest + _longest(part)
        if not 1e-15 < norm < 1e15:  # beyond single precision
            return squares(part, self.rows), rounding(part, self.rows)
        short = part.astype("f4")
        out = short @ self.short.T
        out *= -2
        out += (short * short).sum(1)[:, None]
        out += self.squares
        return out, (part.shape[1] + 8) * 2.0**-22 * norm * norm


class Space:
    """Pivots, and for each bundle its groups (pivot, least and greatest distance), its first unit and their number, and its points."""

    def __init__(self, pivots: np.ndarray, groups: pd.DataFrame, unit: int):
        self.pivots, self.unit = pivots, unit
        order = np.sqrt(squares(pivots, pivots[:1]))[:, 0] if len(pivots) else np.zeros(0)
        groups = groups.assign(order=order[groups["cell"].to_numpy(int)]).sort_values(["order", "cell", "ring"], ignore_index=True)
        bundle, held, number = [], 0, -1
        for n in groups["n"]:  # neighbouring small groups share a unit, a large one has units of its own
            if number < 0 or held + n > unit:
                number, held = number + 1, 0
            held += n
            bundle.append(number)
        self.groups = groups.assign(bundle=bundle)
        self.starts = np.flatnonzero(self.groups["bundle"].diff().fillna(1))
        self.n = np.add.reduceat(self.groups["n"].to_numpy(), self.starts) if len(groups) else np.zeros(0, int)
        self.units = np.maximum(1, -(-self.n // unit))
        self.first = np.cumsum(self.units) - self.units

    def reach(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, bundles): least and greatest distance that the members of each bundle may have."""
        to = np.sqrt(squares(rows, self.pivots))[:, self.groups["cell"]]
        slack = SLACK * (1 + to) + math.sqrt(rounding(rows, self.pivots))
        low = np.maximum(to - self.groups["high"].to_numpy(), self.groups["low"].to_numpy() - to) - slack
        high = to + self.groups["high"].to_numpy() + slack
        return np.maximum(np.minimum.reduceat(low, self.starts, axis=1), 0), np.maximum.reduceat(high, self.starts, axis=1)

    def visits(self, row: np.ndarray, bundle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, units) for pairs of rows and bundles: all units of each bundle."""
        count = self.units[bundle]
        at = np.repeat(self.first[bundle] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(row, count), at


def _sent(batch: pd.DataFrame, row: np.ndarray, unit: np.ndarray, also: tuple[str, ...] = (), **more) -> Iterator[pd.DataFrame]:
    """The visitors (rows of the batch, with the columns `also`, and units), some at a time: each carries a copy of its vector, and a row may visit every unit."""
    step = max(1, SENT // max(1, len(batch["vector"].iloc[0]))) if len(batch) else 1
    for at in range(0, len(row), step):
        yield batch.iloc[row[at : at + step]][["key", "vector", *also]].assign(unit=unit[at : at + step].astype("i4"), **more)


def deal(rows: DataFrame, name: str, unit: int = UNIT) -> tuple[DataFrame, Space]:
    """(rows with bundle and unit, their space) of (key, vector, ...); vectors are of one length. Which points are pivots changes nothing but speed."""
    spark = rows.sparkSession
    n = rows.count()
    wanted = min(PIVOTS, math.isqrt(n) + 1)
    drawn = rows.where(F.rand(5) < min(1.0, 2 * wanted / max(n, 1))).select("vector").collect() or rows.select("vector").limit(1).collect()  # 2 * PIVOTS about
    pivots = np.unique(np.array([r["vector"] for r in drawn[:: max(1, len(drawn) // wanted)][:wanted]], float), axis=0) if drawn else np.zeros((0, 1))
    sent = spark.sparkContext.broadcast(pivots)  # PIVOTS vectors at most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            to = np.concatenate([squares(part, sent.value) for part in _parts(np.stack(batch["vector"]), len(sent.value))])
            yield batch.assign(cell=to.argmin(1).astype("i4"), away=np.sqrt(to.min(1)))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = written(rows.mapInPandas(place, f"{fields}, cell int, away double"), name)
    cuts = [i / RINGS for i in range(1, RINGS)]
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("away", cuts, 1000).alias("cuts")).collect()  # PIVOTS rows
    rings = [(r["cell"], sorted(set(r["cuts"])) if r["n"] > unit else []) for r in cells]
    where = spark.createDataFrame(rings, "cell int, cuts array<double>")
    ringed = placed.join(F.broadcast(where), "cell").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("away"))))
    groups = ringed.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).toPandas()  # PIVOTS * RINGS rows
    space = Space(pivots, groups, unit)
    told = [(int(c), int(r), int(b), int(space.first[b]), int(space.units[b])) for c, r, b in space.groups[["cell", "ring", "bundle"]].itertuples(index=False)]
    told = spark.createDataFrame(told, "cell int, ring int, bundle int, first int, units int")
    dealt = ringed.join(F.broadcast(told), ["cell", "ring"]).withColumn("unit", (F.col("first") + F.pmod(F.xxhash64("key"), "units")).cast("int"))
    return dealt.drop("cell", "ring", "cuts", "away", "first", "units"), space


def _parts(rows: np.ndarray, others: int) -> Iterator[np.ndarray]:
    step = max(1, CELLS // max(1, others))
    for at in range(0, len(rows), step):
        yield rows[at : at + step]


def stream(held: DataFrame, visitors: DataFrame, visit: Callable[[pd.DataFrame, pd.DataFrame, dict], pd.DataFrame], schema: str, units: int) -> DataFrame:
    """What visit(unit's rows, some visitors, what the unit keeps) gives for every unit. Both tables have key, vector and unit, held may have weight and columns of the key's type; a unit's rows are sent once, and its visitors pass them in batches."""
    other = {c: (F.lit(0) if c == "weight" else F.col("key")).alias(c) for c in held.columns if c not in visitors.columns}  # not null, as whole numbers would else become doubles
    both = held.withColumn("visitor", F.lit(0)).unionByName(visitors.withColumns(other | {"visitor": F.lit(1)}))
    spread = max(int(held.sparkSession.conf.get("spark.sql.shuffle.partitions")), units // 4)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, rows, keeps, whole = None, [], {}, None
        for batch in batches:
            for (number, kind), part in batch.groupby(["unit", "visitor"], sort=True):
                if number != unit:
                    unit, rows, keeps, whole = number, [], {}, None
                if kind == 0:
                    rows.append(part)
                    continue
                if whole is None:
                    whole = pd.concat(rows, ignore_index=True) if rows else part.iloc[:0]
                if len(whole):
                    yield visit(whole, part, keeps)

    return both.repartition(spread, "unit").sortWithinPartitions("unit", "visitor").mapInPandas(run, schema)


def _stack(vectors: pd.Series, size: int) -> np.ndarray:
    return np.stack(vectors) if len(vectors) else np.zeros((0, size))


def _best(rows: pd.DataFrame, asked: pd.DataFrame, k: int, limit: np.ndarray | None = None, held: Held | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places asked, places of rows, distances) of the k nearest rows of other keys, for some of the asked at a time; ties to the smaller key; distances are rounded to nine places.

    limit: no row farther than that counts, for each of the asked.
    """
    keys, names, queries = rows["key"].to_numpy(), asked["key"].to_numpy(), np.stack(asked["vector"])
    held = held or Held(np.stack(rows["vector"]))
    few, at = min(k, len(keys)), 0
    order = np.empty(len(keys), int)
    order[np.argsort(keys, kind="stable")] = np.arange(len(keys))
    for part in _parts(queries, len(keys)):
        near, off = held.near(part)
        same = np.nonzero(np.isin(names[at : at + len(part)], keys))[0]
        for n in same:
            near[n, keys == names[at + n]] = np.inf
        if limit is None:
            most = np.partition(near, few - 1, axis=1)[:, few - 1] + off
        else:
            most = (limit[at : at + len(part)] + SLACK) ** 2
        bound = np.nextafter((most + off + SLACK * (1 + most)).astype(near.dtype), np.asarray(np.inf, near.dtype))
        n, m = np.nonzero(near <= bound[:, None])
        some = keys[m] != names[at + n]
        n, m = n[some], m[some]
        away = np.concatenate([np.round(np.sqrt(((held.rows[m[i : i + SOME]] - part[n[i : i + SOME]]) ** 2).sum(1)), 9) for i in range(0, len(n), SOME)]) if len(n) else np.zeros(0)
        if limit is not None:
            some = away <= limit[at + n]
            n, m, away = n[some], m[some], away[some]
        sort = np.lexsort((order[m], away, n))
        n, m, away = n[sort], m[sort], away[sort]
        some = np.arange(len(n)) - np.searchsorted(n, n) < k
        yield at + n[some], m[some], away[some]
        at += len(part)


def knn_graph(df: DataFrame, key: str, columns: list[str], k: int = 10, unit: int = UNIT) -> DataFrame:
    """(src, dst, rank, distance): the k nearest rows of other keys of each row by Euclidean distance (rounded to nine places), ties to the smaller key; exact.

    columns: numbers, or one array of them. Keys are distinct. Rows with a null key or a component that is null or no finite number take no part. A row's k nearest in its own
    unit bound the distance that matters; it then visits the other units that may hold nearer rows.
    """
    rows, space = deal(points(df, key, columns), "knn-points", unit)
    kind = rows.schema["key"].dataType.simpleString()
    found = f"array<struct<distance:double,dst:{kind}>>"

    def own(part: pd.DataFrame) -> pd.DataFrame:
        near, keys = [[] for _ in range(len(part))], part["key"].to_list()
        for asked, at, away in _best(part, part, k):
            for q, x, d in zip(asked.tolist(), at.tolist(), away.tolist(), strict=True):
                near[q].append({"distance": d, "dst": keys[x]})
        return part[["key", "vector", "bundle", "unit"]].assign(near=near)

    first = written(rows.groupBy("unit").applyInPandas(own, f"key {kind}, vector array<double>, bundle int, unit int, near {found}"), "knn-own")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            limit = np.array([near[-1]["distance"] if len(near) == k else np.inf for near in batch["near"]])
            batch, at = batch.assign(limit=limit), 0
            for part in _parts(np.stack(batch["vector"]), max(len(space.groups), int(space.units.sum()))):
                low, _ = space.reach(part)
                row, bundle = np.nonzero(low <= limit[at : at + len(part), None] + SLACK)
                row, units = space.visits(row + at, bundle)
                other = units != batch["unit"].to_numpy()[row]
                yield from _sent(batch, row[other], units[other], ("limit",))
                at += len(part)

    def visit(held: pd.DataFrame, asked: pd.DataFrame, keeps: dict) -> pd.DataFrame:
        if "held" not in keeps:
            keeps["held"] = Held(np.stack(held["vector"]))
        names, keys, out = asked["key"].to_numpy(), held["key"].to_numpy(), []
        for n, m, away in _best(held, asked, k, asked["limit"].to_numpy(), keeps["held"]):
            out.append(pd.DataFrame({"src": names[n], "dst": keys[m], "distance": away}))
        return pd.concat(out)

    schema = f"src {kind}, dst {kind}, distance double"
    more = stream(rows.select("key", "vector", "unit", F.lit(0.0).alias("limit")), first.mapInPandas(route, f"key {kind}, vector array<double>, limit double, unit int"), visit, schema, int(space.units.sum()))
    both = first.select(F.col("key").alias("src"), F.explode("near").alias("n")).select("src", "n.dst", "n.distance").unionByName(more)
    order = Window.partitionBy("src").orderBy("distance", "dst")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("src", "dst", "rank", "distance")


def affinity(graph: DataFrame) -> DataFrame:
    """(src, dst, weight) of a neighbour table made symmetric, src < dst: weight 1 where both rows have each other, else 0.5."""
    ends = graph.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return ends.groupBy("src", "dst").agg((F.count("*") / 2).alias("weight"))


def _within(a: np.ndarray, b: Held, eps: float) -> np.ndarray:
    """(a, b): True where the distance is at most eps; pairs too close to call are computed component by component."""
    near, off = b.near(a)
    off += SLACK * eps * eps
    out = near <= np.asarray(eps * eps - off, near.dtype)
    i, j = np.nonzero((near <= np.asarray(eps * eps + off, near.dtype)) & ~out)
    for at in range(0, len(i), SOME):
        some = slice(at, at + SOME)
        out[i[some], j[some]] = ((a[i[some]] - b.rows[j[some]]) ** 2).sum(1) <= eps * eps
    return out


def _united(groups: list, parent: dict) -> Iterator[tuple]:
    """Joins each of the groups of names; the links that made two into one."""

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for some in groups:
        first = root(some[0])
        for x in some[1:]:
            if (other := root(x)) != first:
                parent[other] = first
                yield first, other


def dbscan(df: DataFrame, columns: list[str], eps: float, least: int, key: str = "hash", unit: int = UNIT) -> DataFrame:
    """(key, core, cluster) of each row: DBSCAN over all columns (numbers, or one array of them) by Euclidean distance.

    A row with at least `least` rows within eps, itself included, is core; cluster is the smallest core key reachable, -1 for noise (null where keys are no numbers); a border row joins its
    smallest cluster. Rows with a component that is null or no finite number are noise. Equal vectors are one point with a weight.
    Points visit units three times: to be counted, to be linked (core points; a spanning forest of the links of each unit goes on, never its
    pairs), and for the smallest cluster at hand (others). Bundles wholly within eps need no visit in any of them.
    """
    spark = df.sparkSession
    able = points(df, key, columns)
    classes = able.groupBy("vector").agg(F.min("key").alias("key"), F.count("*").alias("weight"))
    rows, space = deal(written(classes, "dbscan-classes").select("key", "vector", "weight"), "dbscan-points", unit)
    rows = written(rows, "dbscan-units")
    kind, units = rows.schema["key"].dataType.simpleString(), int(space.units.sum())
    weights = {r["bundle"]: r["w"] for r in rows.groupBy("bundle").agg(F.sum("weight").alias("w")).collect()}
    weight = np.array([weights.get(b, 0) for b in range(len(space.n))])

    def routed(whole: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], made: str):
        """Visitors of the bundles that eps reaches in part; whole(keys, rows, bundles) gives (rows, value) for those within eps."""

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keys, at = batch["key"].to_numpy(), 0
                for part in _parts(np.stack(batch["vector"]), max(len(space.groups), int(space.units.sum()))):
                    low, high = space.reach(part)
                    row, units = space.visits(*np.nonzero((low <= eps) & (high > eps)))
                    yield from _sent(batch, row + at, units, made=None)
                    some, value = whole(keys[at : at + len(part)], *np.nonzero(high <= eps))
                    yield pd.DataFrame({"key": keys[at : at + len(part)][some], "vector": None, "unit": -1, "made": value})
                    at += len(part)

        return route, f"key {kind}, vector array<double>, unit int, made {made}"

    # Who is core: counts of whole bundles, and of what is near in the others.
    def counted(keys, row, bundle):
        total = np.bincount(row, weight[bundle], len(keys)).astype("i8")
        some = np.flatnonzero(total)
        return some, total[some]

    def count(held: pd.DataFrame, asked: pd.DataFrame, keeps: dict) -> pd.DataFrame:
        if "held" not in keeps:
            keeps["held"], keeps["more"] = Held(np.stack(held["vector"])), held["weight"].to_numpy("i8") - 1
        vectors, more = keeps["held"], keeps["more"]
        some, made = np.flatnonzero(more), []
        for part in _parts(np.stack(asked["vector"]), len(vectors.rows)):
            close = _within(part, vectors, eps)
            made.append(np.count_nonzero(close, axis=1) + close[:, some] @ more[some])
        return pd.DataFrame({"key": asked["key"], "made": np.concatenate(made)})

    visitors = written(rows.mapInPandas(*routed(counted, "long")), "dbscan-visits")
    seen = stream(rows.select("key", "vector", "weight", "unit"), visitors.where("unit >= 0").select("key", "vector", "unit"), count, f"key {kind}, made long", units)
    near = seen.unionByName(visitors.where("unit < 0").select("key", "made")).groupBy("key").agg(F.sum("made").alias("n"))
    rows = written(rows.join(near, "key").withColumn("core", F.col("n") >= least).drop("n"), "dbscan-cores")
    core = rows.where("core")

    # Links of core points: each with the first core point of a whole bundle, and a forest in the other units.
    named = {r["bundle"]: r["k"] for r in core.groupBy("bundle").agg(F.min("key").alias("k")).collect()}

    def tied(keys, row, bundle):
        some = np.array([b in named for b in range(len(space.n))], bool)[bundle] if len(bundle) else np.zeros(0, bool)
        row, bundle = row[some], bundle[some]
        head = np.flatnonzero(np.diff(row, prepend=-1))
        links = [(r, [named[bundle[h]]]) for h, r in zip(head, row[head], strict=True)]  # one for each point
        parent: dict = {}
        sets = [[named[b] for b in part] for part in np.split(bundle, head[1:])] if len(bundle) else []
        links += [(0, [a, b]) for a, b in _united(sets, parent)]  # one for each two bundles that are joined
        links += [(0, [named[b], named[b]]) for b in np.unique(bundle)]  # these bundles are of one cluster
        value = np.empty(len(links), object)
        value[:] = [x for _, x in links]
        return np.array([r for r, _ in links], int), value

    def forest(held: pd.DataFrame, asked: pd.DataFrame, keeps: dict) -> pd.DataFrame:
        if "held" not in keeps:
            keeps["held"], keeps["label"] = Held(np.stack(held["vector"])), np.arange(len(held))
        vectors, label, names = keeps["held"], keeps["label"], held["key"].to_numpy()
        out, at, keys = [], 0, asked["key"].to_numpy()
        for part in _parts(np.stack(asked["vector"]), len(names)):
            close = _within(part, vectors, eps)
            for n in np.flatnonzero(close.any(1)):
                some = np.unique(label[close[n]])
                if keys[at + n] != names[some[0]]:
                    out.append((keys[at + n], names[some[0]]))
                if len(some) > 1:  # happens once for each member of the unit at most
                    out += [(names[some[0]], names[s]) for s in some[1:]]
                    label[np.isin(label, some[1:])] = some[0]
            at += len(part)
        return pd.DataFrame(out, columns=["a", "b"])

    visitors = written(core.mapInPandas(*routed(tied, f"array<{kind}>")), "dbscan-visits")
    inside = stream(core.select("key", "vector", "unit"), visitors.where("unit >= 0").select("key", "vector", "unit"), forest, f"a {kind}, b {kind}", units)
    whole = visitors.where("unit < 0").select("key", "made")
    links = inside.unionByName(whole.where("size(made) = 1").select(F.col("key").alias("a"), F.get("made", F.lit(0)).alias("b")))
    links = links.unionByName(whole.where("get(made, 0) <> get(made, 1)").select(F.get("made", F.lit(0)).alias("a"), F.get("made", F.lit(1)).alias("b")))
    one = whole.where("get(made, 0) = get(made, 1)").select(F.get("made", F.lit(0)).alias("b")).distinct()  # a row for each bundle at most
    firsts = spark.createDataFrame(list(named.items()), f"bundle int, b {kind}").join(one, "b")
    links = links.unionByName(core.join(F.broadcast(firsts), "bundle").select(F.col("key").alias("a"), "b"))
    tied_to = components(written(links, "dbscan-links"))
    core = written(core.join(tied_to.withColumnRenamed("node", "key"), "key", "left").withColumn("cluster", F.coalesce("component", "key")).drop("component"), "dbscan-clusters")

    # Border points: the smallest cluster at hand.
    lowest = {r["bundle"]: r["c"] for r in core.groupBy("bundle").agg(F.min("cluster").alias("c")).collect()}

    def bordered(keys, row, bundle):
        found = [(r, lowest[b]) for r, b in zip(row, bundle, strict=True) if b in lowest]
        value = np.empty(len(found), object)
        value[:] = [c for _, c in found]
        return np.array([r for r, _ in found], int), value

    def border(held: pd.DataFrame, asked: pd.DataFrame, keeps: dict) -> pd.DataFrame:
        if "held" not in keeps:
            order = np.argsort(held["cluster"].to_numpy(), kind="stable")  # the first that is near is the smallest
            keeps["held"], keeps["cluster"] = Held(np.stack(held["vector"])[order]), held["cluster"].to_numpy()[order]
        vectors, cluster, names, out, at = keeps["held"], keeps["cluster"], asked["key"].to_numpy(), [], 0
        for part in _parts(np.stack(asked["vector"]), len(cluster)):  # a unit and its visitors have no table of all pairs
            close = _within(part, vectors, eps)
            some = np.flatnonzero(close.any(1))
            out.append(pd.DataFrame({"key": names[at + some], "made": cluster[close[some].argmax(1)]}))
            at += len(part)
        return pd.concat(out)

    visitors = written(rows.where("NOT core").mapInPandas(*routed(bordered, kind)), "dbscan-visits")
    beside = stream(core.select("key", "vector", "cluster", "unit"), visitors.where("unit >= 0").select("key", "vector", "unit"), border, f"key {kind}, made {kind}", units)
    beside = beside.unionByName(visitors.where("unit < 0").select("key", "made")).groupBy("key").agg(F.min("made").alias("cluster"))

    known = core.select("vector", F.lit(True).alias("core"), "cluster").unionByName(rows.join(beside, "key").select("vector", F.lit(False).alias("core"), "cluster"))
    told = able.join(known, "vector").select(F.col("key").alias(key), "core", "cluster")
    noise = F.lit(-1).cast(kind) if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") else F.lit(None).cast(kind)
    return df.select(key).join(told, key, "left").select(key, F.coalesce("core", F.lit(False)).alias("core"), F.coalesce("cluster", noise).alias("cluster"))
