"""Problem 7: splits that keep the records of one repository together.

Which names are one repository: spellings of a name are normalised (percent signs, hosts, ssh remotes, ``.git``, folders
of a web address, blanks, case). Names are linked when a repository's page or clone address carries another name than its
row (it was renamed) and when a record's address names another repository than the record does. The classes are the
connected components of these links, found by alternating large-star and small-star steps; a name never meets all others
of its class in one task. A fork keeps its own address and is another repository.

Assignment, min-cost flow on bundles. Components with the same number of rows of every type of record are a bundle: they
can stand for each other, so the plan holds exactly. Flow goes from
bundles to splits. A split's quota is its share of all rows, and of the rows of every type; the cost is convex, the squared
deviation of rows from quota plus ``LABEL_WEIGHT`` times that of every type. Fractionally the optimum sends the share of
every bundle to each split; it is rounded down. The components left over are unit flows, largest first, each along its
shortest augmenting path: into a split, or into a split and one component from there on into another. Then negative cycles
of the residual graph are cancelled, cheapest first, until there is none among single moves and exchanges of two. Within
a bundle, components take their places in order of hash.

Defined cases: a null or blank name is a repository of its own (one, named ''); repeated rows count as rows; an empty table
gives no rows; without splits nothing is assigned. More than ``MAX_SPLITS`` splits, or names that are not settled after
``MAX_ROUNDS`` rounds of stars, are an error.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiscope.session import cut_lineage

MAX_ROUNDS = 60
MAX_SPLITS = 1000
LABEL_WEIGHT = 0.25
BLOCK = 512
SLICES, SLICE_COMPONENTS = 64, 50_000
#: types of record by which label profiles are told; all others are the last
TYPES = ["code_comment", "commit_message", "issue_body", "pr_body", "other_type"]


def canonical(name: Column) -> Column:
    """One spelling for a repository's name: ``owner/name`` in lower case."""
    s = F.lower(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)%2f", "/")))
    s = F.regexp_replace(s, r"^(https?|ssh|git)://", "")
    s = F.regexp_replace(s, r"^[^/@\s]+@", "")
    s = F.regexp_replace(s, r"^[a-z0-9-]+(\.[a-z0-9-]+)+(:[0-9]+)?[:/](?=[^/]+/)", "")
    s = F.regexp_replace(s, r"\s*/\s*", "/")
    s = F.regexp_replace(s, r"^/+|/+$", "")
    s = F.regexp_replace(s, r"^([^/]+/[^/]+)/.*$", "$1")
    return F.trim(F.regexp_replace(s, r"\.git$", ""))


def name_of_address(url: Column) -> Column:
    """The canonical name in a web or clone address; null where there is none."""
    name = canonical(url)
    return F.when(url.isNotNull() & name.rlike(r"^[^/\s]+/[^/\s]+$"), name)


def name_links(occurrences: DataFrame, repos: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of canonical names that one repository has."""
    # what of an address names a repository ends at the second part of its path; records of one repository are one row then
    short = F.regexp_extract("url", r"^((?:[a-zA-Z]+://)?[^/]*/[^/]*/[^/]*)", 1)
    told = occurrences.select("repo_full_name", F.when(short != "", short).otherwise(F.col("url")).alias("url")).distinct()
    rows = told.select(canonical(F.col("repo_full_name")).alias("a"), name_of_address(F.col("url")).alias("b"))
    pages = repos.select(canonical(F.col("repo_full_name")).alias("a"), F.explode(F.array(name_of_address(F.col("html_url")), name_of_address(F.col("clone_url")))).alias("b"))
    both = rows.unionByName(pages).where((F.col("a") != "") & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(name, root) of every name in ``links``; root is the smallest name of its class.

    Alternating large-star and small-star steps on an edge table, written to the shared folder after every round. A star's
    neighbours are reduced to their minimum, map-side first, so a hub is never gathered in one place.
    """
    edges = cut_lineage(links)
    if edges.isEmpty():
        return edges.select(F.col("a").alias("name"), F.col("b").alias("root"))
    before = None
    for _ in range(MAX_ROUNDS):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        small_least = large.groupBy(F.col("x").alias("a")).agg(F.min("y").alias("m"))
        small = large.select(F.col("x").alias("a"), F.col("y").alias("b")).join(small_least, "a")
        edges = cut_lineage(
            small.where(F.col("b") != F.col("m")).select(F.col("b").alias("b"), F.col("m").alias("a"))
            .unionByName(small_least.select(F.col("a").alias("b"), F.col("m").alias("a"))).where("a <> b").select("a", "b").distinct()
        )
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"links of names not settled after {MAX_ROUNDS} rounds")
    stars = edges.groupBy(F.col("b").alias("name")).agg(F.min("a").alias("root"))
    roots = stars.select(F.col("root").alias("name"), F.col("root")).distinct()
    return stars.unionByName(roots).groupBy("name").agg(F.min("root").alias("root"))


def classes(occurrences: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo_full_name, repository): every stored name with the representative of its class."""
    stored = occurrences.select("repo_full_name").distinct().withColumn("name", canonical(F.col("repo_full_name")))
    return stored.join(components(name_links(occurrences, repos)), "name", "left").select("repo_full_name", F.coalesce("root", "name").alias("repository"))


def same_repository(occurrences: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo_a, repo_b), repo_a < repo_b bytewise: different stored names of one repository."""
    named = classes(occurrences, repos).where(F.col("repo_full_name").isNotNull() & (F.col("repository") != ""))
    several = named.groupBy("repository").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = named.join(several.select("repository"), "repository")  # spellings of names, not records
    a, b = kept.withColumnRenamed("repo_full_name", "repo_a"), kept.withColumnRenamed("repo_full_name", "repo_b")
    return a.join(b, "repository").where(F.col("repo_a") < F.col("repo_b")).select("repo_a", "repo_b")


class Flow:
    """Integral flow of bundles to splits. ``rows`` has a line per bundle: rows of each type in one of its components."""

    def __init__(self, rows: np.ndarray, counts: np.ndarray, shares: np.ndarray):
        self.v = np.column_stack([rows.sum(1), rows]).astype(float)  # all rows, then rows by type
        self.n = counts.astype(np.int64)
        self.w = np.array([1.0] + [LABEL_WEIGHT] * rows.shape[1])
        share = shares / shares.sum() if shares.sum() else np.full(len(shares), 1 / max(1, len(shares)))
        self.x = np.floor(self.n[:, None] * share + 1e-9).astype(np.int64)
        # deviation of each split by dimension: got less wanted
        self.dev = self.x.T @ self.v - share[:, None] * (self.n @ self.v)
        left = np.repeat(np.arange(len(self.n)), self.n - self.x.sum(1))
        self.by_size = np.argsort(-self.v[:, 0], kind="stable")
        for b in left[np.argsort(-self.v[left, 0], kind="stable")]:
            self._augment(int(b))
        while self._cancel():
            pass

    def cost(self) -> float:
        return float((self.w * self.dev**2).sum())

    def _move_costs(self, some: np.ndarray, j: int, k: int) -> np.ndarray:
        """Change of the cost when one component of each bundle in ``some`` goes from split j to split k."""
        v = self.v[some]
        return (2 * v * (v + self.dev[k] - self.dev[j])) @ self.w

    def _apply(self, b: int, j: int | None, k: int) -> None:
        if j is not None:
            self.x[b, j] -= 1
            self.dev[j] -= self.v[b]
        self.x[b, k] += 1
        self.dev[k] += self.v[b]

    def _augment(self, b: int) -> None:
        splits = range(len(self.dev))
        v = self.v[b]
        into = [float((self.w * (2 * v * self.dev[j] + v * v)).sum()) for j in splits]
        best = min((c, j, -1, -1) for j, c in enumerate(into))
        both = 2 * (self.v[self.by_size] * v) @ self.w
        for j in splits:
            here = np.flatnonzero(self.x[self.by_size, j] > 0)
            if len(here):
                for k in splits:
                    if k != j:
                        path = into[j] + self._move_costs(self.by_size[here], j, k) - both[here]
                        at = int(path.argmin())
                        if path[at] < best[0] - 1e-9:
                            best = (float(path[at]), j, int(self.by_size[here[at]]), k)
        _, j, other, k = best
        self._apply(b, None, j)
        if other >= 0:
            self._apply(other, j, k)

    def _cancel(self) -> bool:
        """Cancel the cheapest negative cycle: a move, or an exchange between two splits. False where there is none."""
        least, found = -1e-9 * max(1.0, self.cost()), None
        for j in range(len(self.dev)):
            for k in range(len(self.dev)):
                out = np.flatnonzero(self.x[:, j] > 0)
                if j == k or not len(out):
                    continue
                there = self._move_costs(out, j, k)
                at = int(there.argmin())
                if there[at] < least:
                    least, found = float(there[at]), [(int(out[at]), j, k)]
                back = np.flatnonzero(self.x[:, k] > 0)
                if k < j or not len(back):
                    continue
                here = self._move_costs(back, k, j)
                cross = 4 * self.v[back] * self.w
                for lo in range(0, len(out), BLOCK):  # every pair, a block at a time
                    pair = there[lo : lo + BLOCK, None] + here[None, :] - self.v[out[lo : lo + BLOCK]] @ cross.T
                    p, q = np.unravel_index(int(pair.argmin()), pair.shape)
                    if pair[p, q] < least:
                        least, found = float(pair[p, q]), [(int(out[lo + p]), j, k), (int(back[q]), k, j)]
        for move in found or []:
            self._apply(*move)
        return found is not None


def bundled(comps: DataFrame) -> DataFrame:
    """``comps`` with its bundle: the rows of each type, so that all components of a bundle are alike."""
    return comps.withColumn("bundle", F.concat_ws("-", *[F.col(t).cast("string") for t in TYPES]))


def assign(occurrences: DataFrame, repos: DataFrame, shares: DataFrame) -> DataFrame:
    """(repository, n_rows, split_name): every repository with its split.

    Only the bundles reach the driver, and the plan goes back as their ranges: a row per different number of rows by type, which
    grows more slowly than the components, but with them.
    """
    from pyspark.sql import Window

    wanted = [(r.split_name, float(r.target_share or 0)) for r in shares.orderBy("split_name").limit(MAX_SPLITS + 1).collect()]
    if len(wanted) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    named = cut_lineage(classes(occurrences, repos))
    per_name = occurrences.groupBy("repo_full_name", F.lower(F.trim("artifact_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    per_type = per_name.alias("o").join(named.alias("c"), F.col("o.repo_full_name").eqNullSafe(F.col("c.repo_full_name")))
    of = F.when(F.col("kind").isin(TYPES[:-1]), F.col("kind")).otherwise(TYPES[-1])
    by_type = [F.coalesce(F.sum(F.when(of == t, F.col("n"))), F.lit(0)).alias(t) for t in TYPES]
    comps = cut_lineage(bundled(per_type.groupBy("repository").agg(F.sum("n").alias("n_rows"), *by_type)))
    bundles = comps.groupBy("bundle").agg(F.count(F.lit(1)).alias("n"), *[F.avg(t).alias(t) for t in TYPES]).orderBy("bundle").collect()
    if not wanted or not bundles:
        return comps.select("repository", "n_rows").limit(0).withColumn("split_name", F.lit(None).cast("string"))
    plan = Flow(np.array([[float(b[t]) for t in TYPES] for b in bundles]), np.array([b.n for b in bundles]), np.array([w for _, w in wanted])).x
    upto = []
    for b, counts in zip(bundles, plan):
        ends = np.cumsum(counts)
        upto += [(b.bundle, int(e - n + 1), int(e), split) for (split, _), n, e in zip(wanted, counts, ends) if n]
    ranges = comps.sparkSession.createDataFrame(upto, "bundle string, lo bigint, hi bigint, split_name string")
    place = F.row_number().over(Window.partitionBy("bundle", "slice").orderBy(F.xxhash64("repository"), "repository"))
    # a bundle may hold most repositories: its order by hash is built from slices of the hash, each ordered by itself
    slices = max(SLICES, sum(b.n for b in bundles) // SLICE_COMPONENTS)
    sliced = comps.select("repository", "n_rows", "bundle", F.pmod(F.xxhash64("repository"), F.lit(slices)).alias("slice"))
    sizes = sliced.groupBy("bundle", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("bundle").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("offset", F.coalesce(before, F.lit(0))).drop("n")
    ranked = sliced.withColumn("i", place).join(offsets, ["bundle", "slice"]).withColumn("i", F.col("i") + F.col("offset"))
    return ranked.join(F.broadcast(ranges), "bundle").where(F.col("i").between(F.col("lo"), F.col("hi"))).select("repository", "n_rows", "split_name")


def label_shares(occurrences: DataFrame, repos: DataFrame, shares: DataFrame) -> DataFrame:
    """(split_name, artifact_type, n_rows, share): what part of each type's rows a split holds."""
    from pyspark.sql import Window

    by_name = classes(occurrences, repos).join(assign(occurrences, repos, shares).select("repository", "split_name"), "repository")
    per = occurrences.groupBy("repo_full_name", F.lower(F.trim("artifact_type")).alias("artifact_type")).agg(F.count(F.lit(1)).alias("n"))
    joined = per.alias("o").join(by_name.alias("c"), F.col("o.repo_full_name").eqNullSafe(F.col("c.repo_full_name")))
    out = joined.groupBy("split_name", "artifact_type").agg(F.sum("n").alias("n_rows"))
    return out.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy("artifact_type")))


def split_records(occurrences: DataFrame, repos: DataFrame, shares: DataFrame) -> DataFrame:
    """All records with the repository that their name means and its split; joined by name, one row per name."""
    named = classes(occurrences, repos).join(assign(occurrences, repos, shares).select("repository", "split_name"), "repository")
    by_name = named.select(F.col("repo_full_name").alias("_name"), "repository", "split_name")
    own = occurrences.drop("repository", "split_name")  # columns of these names are replaced
    return own.join(by_name, F.col("repo_full_name").eqNullSafe(F.col("_name")), "left").drop("_name")
