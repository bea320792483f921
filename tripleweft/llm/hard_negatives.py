"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction. For the candidates of a block and one
cluster, the score with any member is at most the member's norm times the
candidate's norm times the cosine of the angle between candidate and centroid,
less the cluster's widest angle (the triangle inequality on angles). The
candidates are sorted by that bound once per cluster; every member walks the
list from its head and stops as soon as the bound proves that nothing further
down can enter its results.

Blocks of candidates meet groups of anchors in a cogroup. A task therefore
holds one block and one group, whatever the size of the table. Each gives its
own first ranks, and the first of them all are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tripleweft.llm.runtime import materialize, prepare

SCALE = 256
EVERY, RELABEL, LABELS = 100, 7, 10  # anchors by id; ids whose label moves on; number of labels
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90  # a negative's score lies between these percentages of the positive's
BLOCK_BYTES = 64 << 20  # vectors of a block of candidates
MIN_BLOCK_ROWS = 4096  # blocks are not made smaller than that to have more of them
GROUP_ANCHORS = 16_384  # anchors that meet a block in one task
SAMPLE_ANCHORS = 8_192  # anchors that centroids are fitted on: those with the smallest hashes
PER_CENTROID, MAX_CENTROIDS = 32, 256  # anchors aimed at in a cluster
STEP = 256  # candidates walked before the bound is tested again, doubled up to MAX_STEP
MAX_STEP = 4096
_EXACT = 2.0**53  # whole numbers up to here are exact in floating point
_SLACK = 1e-6  # more than the error of an angle


def usable_rows(embeddings: DataFrame) -> DataFrame:
    """`vec_id, label, vector` of the rows that take part, one for an id.

    Without a null id or label, a null vector, or a null or non-finite
    component. Of rows that repeat an id the one with the least label and
    vector counts. Ids divisible by 7 move on to the next label.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(finite)
    moved = F.when(F.col("vec_id") % RELABEL == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    one = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row"))
    return one.select("vec_id", F.col("row.label").alias("label"), F.col("row.embedding").alias("vector")).withColumn("label", moved)


def scaled(vectors: pa.Array, width: int) -> np.ndarray:
    """Whole components floor(256 x) as doubles; short vectors are filled up with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    length = np.asarray(pc.list_value_length(vectors)).astype(np.int64)
    out = np.zeros((len(vectors), width))
    out[np.arange(width) < length[:, None]] = flat
    return out


def fit_centroids(vectors: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Directions of clusters: k-means on the unit sphere, started from spread members."""
    norm = np.linalg.norm(vectors, axis=1)
    unit = vectors[norm > 0] / norm[norm > 0, None]
    k = min(MAX_CENTROIDS, -(-len(unit) // PER_CENTROID))
    if k == 0:
        return np.zeros((1, vectors.shape[1]))
    centroids = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(rounds):
        nearest = (unit @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids


def _angles(vectors: np.ndarray, norms: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Angles to a unit vector; that of a zero vector is 0."""
    cosine = np.where(norms > 0, vectors @ centroid / np.where(norms > 0, norms, 1), 1)
    return np.arccos(np.clip(cosine, -1, 1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of whole components, exact for any that 64 bits hold."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < _EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return (whole[0] @ whole[1].T).astype(np.int64)


class Requests:
    """What the members of a cluster look for: per request the first `k` allowed candidates."""

    def __init__(self, member: np.ndarray, k: int, low: np.ndarray | None = None, high: np.ndarray | None = None):
        none = np.full(len(member), np.iinfo(np.int64).min)
        self.member, self.k = member, k
        self.low = none if low is None else low  # least score
        self.high = ~none if high is None else high  # largest score
        self.found = [np.zeros(0, np.int64) for _ in range(3)]  # request, score, candidate id
        self.threshold = self.low.copy()  # the least score that still matters

    def offer(self, request: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        request, score, ids = (np.concatenate(pair) for pair in zip(self.found, (request, score, ids), strict=True))
        order = np.lexsort((ids, -score, request))
        request, score, ids = request[order], score[order], ids[order]
        first = np.flatnonzero(np.diff(request, prepend=-1))
        rank = np.arange(len(request)) - np.repeat(first, np.diff(np.append(first, len(request))))
        last = rank == self.k - 1
        self.threshold[request[last]] = np.maximum(self.low[request[last]], score[last])
        self.found = [x[rank < self.k] for x in (request, score, ids)]


def walk(members: dict, candidates: dict, centroid: np.ndarray, requests: Requests, same_label: bool) -> None:
    """Let every request walk the cluster's list of candidates until its end is certified.

    `members` and `candidates` hold `ids, labels, vectors, norms`. A request is
    over when the bound of all that follows is below the score of its last
    rank, so that ties by id are still seen, or below the least score asked for.
    """
    widest = _angles(members["vectors"], members["norms"], centroid).max()
    away = _angles(candidates["vectors"], candidates["norms"], centroid) - widest - _SLACK
    bound = candidates["norms"] * np.cos(np.maximum(away, 0))
    listed = np.argsort(-bound, kind="stable")
    live, at, step = np.arange(len(requests.member)), 0, STEP
    while len(live) and at < len(listed):
        following = bound[listed[at]] * members["norms"][requests.member[live]]
        live = live[following + 1e-9 * np.abs(following) + 1 >= requests.threshold[live]]
        part = listed[at : at + step]
        own, row = np.unique(requests.member[live], return_inverse=True)
        score = _products(members["vectors"][own], candidates["vectors"][part])
        alike = members["labels"][own][:, None] == candidates["labels"][part]
        allowed = alike & (members["ids"][own][:, None] != candidates["ids"][part]) if same_label else ~alike
        fits = allowed[row] & (score[row] >= requests.threshold[live][:, None]) & (score[row] <= requests.high[live][:, None])
        request, candidate = np.nonzero(fits)
        if len(request):
            requests.offer(live[request], score[row[request], candidate], candidates["ids"][part[candidate]])
        at, step = at + step, min(2 * step, MAX_STEP)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """`anchor_id, positive_id, rank, negative_id, positive_score, negative_score`.

    Anchors are the ids divisible by 100, positives their first 5 others of the
    same label, negatives the first 10 of other labels that score from 30 to
    90 % of the positive. First is the larger score, then the smaller id.
    Vectors of unequal length are filled up with zeros; scores must fit into 64
    bits. Rows without id, label or a finite vector take no part, repeated ids
    count once, and an empty table gives no rows; other columns are not read.
    """
    spark = prepare(embeddings.sparkSession)
    rows = materialize(usable_rows(embeddings), "vectors")
    anchors = rows.where(F.col("vec_id") % EVERY == 0)
    n_rows, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    sample = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ANCHORS).select("vector")
    centroids = fit_centroids(scaled(sample.toArrow()["vector"], width))

    def assign(batches):
        for batch in batches:
            vectors = scaled(batch.column("vector"), width)
            yield batch.append_column("cluster", pa.array((vectors @ centroids.T).argmax(axis=1), pa.int32()))

    kind = rows.schema["vector"].dataType.simpleString()
    anchors = materialize(anchors.mapInArrow(assign, f"vec_id bigint, label int, vector {kind}, cluster int"), "anchors")
    sizes = {r["cluster"]: r["count"] for r in anchors.groupBy("cluster").count().collect()}  # a row for a centroid
    group = _groups(sizes)
    n_groups = 1 + max([first + parts - 1 for first, parts in group.values()], default=0)
    places = spark.createDataFrame([(c, first, parts) for c, (first, parts) in group.items()], "cluster int, first int, parts int")
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    anchors = anchors.join(F.broadcast(places), "cluster").select("vec_id", "label", "vector", "cluster", (F.col("first") + part).alias("group"))

    most_rows = max(1, BLOCK_BYTES // (8 * max(width, 1)))
    n_blocks = max(-(-n_rows // most_rows), min(-(-n_rows // MIN_BLOCK_ROWS), spark.sparkContext.defaultParallelism), 1)
    block = F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(n_blocks)).cast("int")
    blocks = rows.withColumn("block", block).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))

    def search(asked: DataFrame, k: int, same_label: bool) -> DataFrame:
        def run(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
            found = _search(mine.combine_chunks(), theirs.combine_chunks(), centroids, width, k, same_label)
            return pa.table(found, names=["anchor_id", "positive_id", "positive_score", "id", "score"])

        met = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).groupBy("group", "block")
        schema = "anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"
        found = met.cogroup(blocks.groupBy("group", "block")).applyInArrow(run, schema)
        rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    none = F.array().cast("array<struct<id:bigint,score:bigint>>")
    positives = search(anchors.withColumn("positives", none), POSITIVES, True)
    listed = positives.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("positives"))  # at most 5
    asked = materialize(anchors.join(listed.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "positives")
    negatives = search(asked, NEGATIVES, False)
    return negatives.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _groups(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each cluster its first group and over how many groups it is spread; small ones share a group."""
    out, group, held = {}, 0, 0
    for cluster, size in sorted(sizes.items()):
        parts = -(-size // GROUP_ANCHORS)
        if held and held + size > GROUP_ANCHORS:
            group, held = group + 1, 0
        out[cluster] = (group, parts)
        if parts > 1:
            group, held = group + parts, 0
        else:
            held += size
    return out


def _rows(table: pa.Table, width: int) -> dict:
    vectors = scaled(table["vector"], width)
    return {"ids": table["vec_id"].to_numpy(), "labels": table["label"].to_numpy(), "vectors": vectors, "norms": np.linalg.norm(vectors, axis=1)}


def _search(mine: pa.Table, theirs: pa.Table, centroids: np.ndarray, width: int, k: int, same_label: bool) -> list[pa.Array]:
    """The first `k` of one block for every request of one group of anchors."""
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
    candidates = _rows(theirs, width)
    cluster = mine["cluster"].to_numpy()
    for c in np.unique(cluster) if len(candidates["ids"]) else ():
        own = mine.filter(pa.array(cluster == c))
        members = _rows(own, width)
        if same_label:
            member = np.arange(len(own))
            positive_id = positive_score = np.zeros(len(own), np.int64)
            requests = Requests(member, k)
        else:
            lists = own["positives"].combine_chunks()
            member = np.repeat(np.arange(len(own)), np.asarray(pc.list_value_length(lists)))
            positive_id, positive_score = (np.asarray(lists.flatten().field(i)).astype(np.int64) for i in (0, 1))
            # whole scores s with LEAST * p <= 100 s <= MOST * p, without leaving 64 bits
            whole, rest = np.divmod(positive_score, 100)
            requests = Requests(member, k, LEAST * whole - (-LEAST * rest // 100), MOST * whole + MOST * rest // 100)
        walk(members, candidates, centroids[c], requests, same_label)
        request, score, ids = requests.found
        for column, values in zip(out, (members["ids"][member[request]], positive_id[request], positive_score[request], ids, score), strict=True):
            column.append(values)
    return [pa.array(np.concatenate(column), pa.int64()) for column in out]


SQL = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, id, score FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), found AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
  FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.alike
  WHERE 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10"""
