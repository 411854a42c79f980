"""Sharding by balanced label propagation: linked documents move towards the shards of their neighbours, under quotas that keep the shards even.

Links are memberships (document, hub): documents of one hub are neighbours of each other, and no pair of them is ever formed. A round is
a count per hub and shard, a join of those few counts to the hub's members and a narrow table; texts are read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.tables import global_rank
from .common import cut

#: Movers between two shards are let through in the order of so many classes of hubs, and of documents within a class.
HUB_CLASSES, ROW_CLASSES = 256, 64
#: So often quotas count on those who leave a shard; after that they don't, which always fits.
TRIES = 5


def capacities(n: int, shards: int) -> list[int]:
    """Rows of each shard: the same number, and one more in the first ``n % shards``."""
    return [n // shards + (s < n % shards) for s in range(shards)]


def quotas(wishes: dict[tuple[int, int], int], sizes: list[int], most: list[int], swaps: bool = True) -> dict[tuple[int, int], int]:
    """How many of those who wish to go from shard i to j may do so, such that no shard ends over ``most``; without ``swaps``, not even if nobody left it.

    As many as go from j to i may go from i to j. Of all others, who comes into a shard that would be over is cut by the number that is too much,
    largest wishes first. That keeps others in their shards, which may then be over in turn; these quotas only fall, and with none left the sizes are what they were, so this ends.
    """
    even = {(i, j): min(n, wishes.get((j, i), 0)) if swaps else 0 for (i, j), n in wishes.items()}
    more = {k: n - even[k] for k, n in wishes.items()}
    while True:
        after = list(sizes)
        for (i, j), n in more.items():
            after[i] -= n if swaps else 0
            after[j] += n
        over = [s for s, n in enumerate(after) if n > most[s]]
        if not over:
            return {k: even[k] + n for k, n in more.items() if even[k] + n}
        for s in over:
            excess = after[s] - most[s]
            while excess:  # the largest are brought down to the next, then together
                coming = sorted((k for k in more if k[1] == s and more[k]), key=lambda k: (-more[k], k))
                top = [k for k in coming if more[k] == more[coming[0]]]
                step = more[top[0]] - (more[coming[len(top)]] if len(top) < len(coming) else 0)
                for at, k in enumerate(top):
                    less = min(step, excess // len(top) + (at < excess % len(top)) if step * len(top) > excess else step)
                    more[k] -= less
                excess -= min(excess, step * len(top))


def cut_links(members: DataFrame) -> DataFrame:
    """(links, cut), one row: pairs of neighbours, and those of them in different shards, of members (hub, shard); counted, never formed."""
    pairs = lambda n: n * (n - 1) / 2
    per = members.groupBy("hub", "shard").agg(F.count("*").alias("n")).groupBy("hub").agg(F.sum("n").alias("n"), F.sum(pairs(F.col("n"))).alias("same"))
    return per.agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0.0)).cast("long").alias("links"), F.coalesce(F.sum(pairs(F.col("n")) - F.col("same")), F.lit(0.0)).cast("long").alias("cut"))


def _wishes(members: DataFrame, shards: int, closed: set[int], turn: int) -> DataFrame:
    """(row, shard, target, class) of the rows with more neighbours (themselves among them) in another shard that is open. Ties are settled alike for all rows of a hub, so that two halves of it don't swap places, and anew every turn, so that a hub finds those it can change with."""
    counts = members.groupBy("hub").agg(*(F.sum((F.col("shard") == s).cast("long")).alias(f"n{s}") for s in range(shards)))
    votes = members.join(cut(counts), "hub")
    rows = votes.groupBy("row", "shard").agg(*(F.sum(f"n{s}").alias(f"n{s}") for s in range(shards)), F.min("hub").alias("hub"))
    worth = lambda s: F.struct(F.col(f"n{s}").alias("n"), F.xxhash64("hub", F.lit(s), F.lit(turn)).alias("tie"), F.lit(s).alias("s"))
    best = F.array_max(F.array(*(worth(s) if s not in closed else F.when(F.col("shard") == s, worth(s)) for s in range(shards))))
    order = F.pmod(F.xxhash64("hub"), F.lit(HUB_CLASSES)) * ROW_CLASSES + F.pmod(F.xxhash64("row", F.lit(1)), F.lit(ROW_CLASSES))
    return rows.select("row", "shard", best["s"].alias("target"), order.alias("class")).where("target <> shard")


def _granted(wishes: DataFrame, asked: dict[tuple[int, int], int], sizes: list[int], most: list[int]) -> DataFrame:
    """(row, target) of the movers within the quotas: on each way from shard to shard, classes of movers in order as long as they fit whole. Counts per class decide; no rows are ranked.

    A way's last class may not fit whole, so that fewer leave a shard than its quota says; then quotas are set anew from what fits.
    """
    counts = wishes.groupBy("shard", "target", "class").agg(F.count("*").alias("n"))
    classes = cut(counts.select("shard", "target", "class", F.sum("n").over(W.partitionBy("shard", "target").orderBy("class")).alias("upto")))
    allowed, tries = quotas(asked, sizes, most), 0
    while True:
        ways = wishes.sparkSession.createDataFrame([(i, j, n) for (i, j), n in allowed.items()], "shard int, target int, quota long")
        fits = cut(classes.join(ways, ["shard", "target"]).where("upto <= quota").groupBy("shard", "target").agg(F.max("class").alias("last"), F.max("upto").alias("n")))
        fitting, tries = {(r["shard"], r["target"]): r["n"] for r in fits.collect()}, tries + 1
        allowed = quotas(fitting, sizes, most, swaps=tries < TRIES)
        if allowed == fitting or tries > TRIES:
            return wishes.join(fits, ["shard", "target"]).where(F.col("class") <= F.col("last")).select("row", "target")


def propagate(members: DataFrame, most: list[int], rounds: int = 30) -> DataFrame:
    """(row, hub) memberships -> (row, shard): rows are dealt evenly at first, then move round by round. Rows are numbers from 0 without gaps (unlinked ones take no part).

    ``most`` are the rows that each shard can take, as ``capacities`` gives them. A shard that lets in less than a tenth of those who ask for it is full and closed from
    then on, so that what is left of a hub larger than a shard gathers in the next one. It ends when nobody moves and no shard closes, or after ``rounds``.
    """
    shards, closed = len(most), set()
    state = cut(members.select("row", "hub", F.pmod("row", F.lit(shards)).cast("int").alias("shard")))
    for turn in range(rounds):
        wishes = cut(_wishes(state, shards, closed, turn))
        asked = {(r["shard"], r["target"]): r["n"] for r in wishes.groupBy("shard", "target").agg(F.count("*").alias("n")).collect()}
        if not asked:
            break
        found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count_distinct("row").alias("n")).collect()}
        moves = cut(_granted(wishes, asked, [found.get(s, 0) for s in range(shards)], most))
        moved = {r["target"]: r["n"] for r in moves.groupBy("target").agg(F.count("*").alias("n")).collect()}
        tight = {s for s in range(shards) if 10 * moved.get(s, 0) < sum(n for (_, j), n in asked.items() if j == s)}
        if not moved and tight <= closed:
            break
        closed |= tight
        state = cut(state.join(moves, "row", "left").select("row", "hub", F.coalesce("target", "shard").alias("shard")))
    return state.select("row", "shard").distinct()


def text_hubs(rows: DataFrame) -> DataFrame:
    """(row, hub) of rows whose text (h1, h2) another row has too."""
    hubs = cut(rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"))
    return rows.join(hubs, ["h1", "h2"]).select("row", F.concat_ws(":", "h1", "h2").alias("hub"))


def balanced_shards(documents: DataFrame, links: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, rounds: int = 30) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): every document's shard, of even numbers of rows (law ``rows``: at most one apart), and its place there, 0, 1, 2, ...

    ``links`` (id, hub) names the neighbours: documents with the same hub; without it, rows with equal texts are (null counts as empty).
    Linked documents are placed by ``propagate``; all others, which no cut depends on, fill the shards up. A hub larger than a shard fills several.
    ``size`` is the text's UTF-8 bytes plus 1, ``text_crc32`` its unsigned CRC-32; a null text has size 1 and CRC 0. ``grown_shard`` is null under this law.
    Every row is placed, also those that repeat id and text; a null id is an id without links of its own. Fewer documents than shards leave shards empty; an empty table gives no rows.
    Other columns are ignored. Between shards, at most shards^2 counts reach the driver, and movers are counted in at most 16,384 classes a way.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = documents.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    base = cut(global_rank(base.withColumn("mix", F.xxhash64("id", "h1")), "row", F.col("mix"), F.col("id"), F.col("h2")))
    n = base.count()
    members = text_hubs(base) if links is None else base.join(links.toDF("id", "hub").where("hub is not null").distinct(), "id").select("row", F.col("hub").cast("string").alias("hub"))
    most = capacities(n, shards)
    placed = cut(propagate(members, most, rounds))
    taken = [0] * shards
    for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect():
        taken[r["shard"]] = r["n"]
    all_rows = base.join(placed, "row", "left").select("id", "size", "crc", "shard", "row")
    ranked = global_rank(all_rows, "rank", F.col("shard").asc_nulls_last(), F.col("row"))
    starts, fills, at, free = [], [], 0, sum(taken)
    for s in range(shards):
        starts.append(at)
        fills.append(free)
        at, free = at + taken[s], free + most[s] - taken[s]
    of = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    filled = F.size(F.filter(of(fills), lambda f: f <= F.col("rank"))) - 1
    last = F.coalesce("shard", filled.cast("int"))
    slot = F.when(F.col("shard").isNotNull(), F.col("rank") - F.get(of(starts), F.col("shard"))).otherwise(F.get(of(taken), last) + F.col("rank") - F.get(of(fills), last))
    return ranked.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), last.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

