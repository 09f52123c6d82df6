"""Filling fixed-capacity containers with items of varying length.

The configuration linear program over the length histogram is solved by multiplicative weights: each
round the items' weights price a best configuration by a knapsack dynamic program, a share of the containers
in whole numbers is filled so, and the weights of the lengths covered ahead of the rest fall. Rounding is part
of each round, so the weights answer for the rounded solution, and the last tenth of the tokens, with the
mixture of the whole, is packed best-fit. The trivial dual solution (every token weighs 1 / capacity) bounds
the program from below; ``quality`` reports the gap to it and the share of containers that come from the
program. Only the histogram (at most ``capacity`` rows) and the configurations are on the driver. Documents
find their container by their rank among those of their length, counted over hash buckets, so no length is
sorted as a whole however hot it is.

A text longer than the capacity is cut into full containers and one rest, which is packed like any
other item; no other text is cut.

Defined results: NULL and empty texts have no tokens and go into no container; ties are cut by id;
empty tables give empty results; repeated rows of one document id count once.
"""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallysheet.session import written

TOKENIZER = os.environ.get("TALLYSHEET_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern that belongs to the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
MAX_CAPACITY = 1 << 16
PART_CHARS = 200_000  # a very long text is handed to the tokenizer in parts of about this length
_BORDER = re.compile(r"(?<=\S) (?=[^\s])")  # before such a blank every tokenisation begins a new piece

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The public tokenizer, loaded once per worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def parts(text: str) -> Iterator[str]:
    """The whole text in parts whose tokens are those of the whole: cut only where the split pattern begins a
    new piece in any case, however far that is."""
    at = 0
    while len(text) - at > PART_CHARS:
        m = _BORDER.search(text, at + PART_CHARS)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_lengths(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every document with at least one token; each text is tokenised whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) if len(t) <= PART_CHARS else sum(len(encode(p)) for p in parts(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    docs = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id bigint, tokens bigint").groupBy("doc_id").agg(F.max("tokens").alias("tokens")).where("tokens > 0")


def price(lengths: np.ndarray, weights: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Counts per length of a best configuration: bounded knapsack by dynamic programming over the capacity.

    A length enters in binary parts of its multiplicity, each one vector operation over all capacities.
    """
    parts = []
    for i in np.flatnonzero((weights > 0) & (most > 0) & (lengths <= capacity)).tolist():
        m, k = int(min(most[i], capacity // lengths[i])), 1
        while m > 0:
            k = min(k, m)
            parts.append((i, k, int(lengths[i]) * k, float(weights[i]) * k))
            m -= k
            k *= 2
    best = np.zeros(capacity + 1)
    took = np.zeros((len(parts), capacity + 1), dtype=bool)
    for row, (_, _, size, value) in zip(took, parts, strict=True):
        with_it = best[: capacity + 1 - size] + value
        np.greater(with_it, best[size:] + 1e-12, out=row[size:])
        np.maximum(best[size:], with_it, out=best[size:])
    out = np.zeros(len(lengths), dtype=np.int64)
    room = capacity
    for j in range(len(parts) - 1, -1, -1):
        i, k, size, _ = parts[j]
        if took[j, room]:
            out[i] += k
            room -= size
    return out


def _program(lengths: np.ndarray, need: np.ndarray, capacity: int, rounds: int, eps: float, leave: float) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """(configurations with their containers, items left) of the covering program, by multiplicative weights.

    Each round prices a best configuration under the present weights and gives it a ``rounds``-th of all
    containers, rounded to whole ones that what is left can fill. The weights of lengths that are covered ahead
    of the rest fall and those behind rise, so what is left keeps the mixture of the whole; the last share
    ``leave`` of the tokens is left to the caller.
    """
    left = need.copy()
    total = float((lengths * need).sum())
    share = max(1, round(total / capacity / rounds))
    out: list[tuple[np.ndarray, int]] = []
    stale = 0
    while stale < 8:
        rest = float((lengths * left).sum())
        if rest < max(2 * capacity, leave * total):
            break
        ahead = (need - left) / np.maximum(need, 1) - (1 - rest / total)
        # lengths with few items left are for the end: a configuration of them could not be repeated
        often = left >= max(1.0, (left.sum() / max(1, (left > 0).sum())) / 3 / (1 + stale))
        y = np.where(often, lengths / capacity * np.exp(-eps * np.clip(ahead * rounds, -60, 60) * (1 + stale) / 8), 0.0)
        config = price(lengths, y, np.minimum(left, 1) if often.sum() > 64 else left, capacity)
        hit = config > 0
        if not hit.any():
            break
        n = int(min(share, (left[hit] // config[hit]).min()))
        if int((config * lengths).sum()) < capacity and stale < 7:
            stale += 1  # not full under these weights: ask again with other ones
            continue
        stale = 0
        left = left - n * config
        out.append((config, n))
    return out, left


Plan = list[tuple[dict[int, int], int, bool]]  # configuration, containers, whether the program made it


def _count(plan: Plan) -> int:
    return sum(n for _, n, _ in plan)


def _bound(histogram: dict[int, int], capacity: int) -> int:
    return -(-sum(s * n for s, n in histogram.items()) // capacity)


def _plan(histogram: dict[int, int], capacity: int, loosest: tuple[float, ...] = (0.02, 0.05, 0.1, 0.25)) -> Plan:
    """The rounded program; then a share of its containers, those with most unused space, is emptied and packed
    anew best-fit where that saves any."""
    best = _solve(histogram, capacity)
    for share in loosest:
        if _count(best) <= _bound(histogram, capacity):
            break
        best = min(best, _repack(best, capacity, share), key=_count)
    return best


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(configuration: length -> count, containers)] that hold every item of the histogram."""
    return [(config, n) for config, n, _ in _plan(histogram, capacity)]


def quality(histogram: dict[int, int], capacity: int) -> dict[str, float]:
    """Containers, the program's lower bound, the gap between them, and the share the program made."""
    plan = _plan(histogram, capacity)
    n, low = _count(plan), _bound(histogram, capacity)
    return {"containers": n, "bound": low, "gap": (n - low) / max(1, low), "program_share": sum(m for _, m, own in plan if own) / max(1, n)}


def _repack(plan: Plan, capacity: int, share: float) -> Plan:
    """The plan with the loosest containers, a share of all, packed again."""
    order = sorted(plan, key=lambda p: sum(s * k for s, k in p[0].items()))
    todo, at = share * _count(plan), 0
    rest: dict[int, int] = {}
    while at < len(order) and todo > 0:
        config, n, _ = order[at]
        for s, k in config.items():
            rest[s] = rest.get(s, 0) + k * n
        todo -= n
        at += 1
    lengths = np.array(sorted(rest), dtype=np.int64)
    return order[at:] + _best_fit(lengths, np.array([rest[int(s)] for s in lengths], dtype=np.int64), capacity)


def _best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> Plan:
    """One container pattern at a time, repeated as often as what is left allows."""
    out = []
    while left.any():
        config = _fill(lengths, left, capacity)
        hit = config > 0
        n = int((left[hit] // config[hit]).min())
        left = left - n * config
        out.append(({int(lengths[i]): int(config[i]) for i in np.flatnonzero(hit)}, n, False))
    return out


def _solve(histogram: dict[int, int], capacity: int, kept: float = 4.0, rounds: int = 48, eps: float = 0.35, leave: float = 0.1) -> Plan:
    """One plan.

    Up to 2,048 tokens the program is solved over the lengths themselves; beyond, over classes of
    ``capacity / 512`` tokens, rounded up. Then short items worth ``kept`` times the space that rounding
    lengths up gives away are held back and put exactly into that space. What remains is packed best-fit.
    """
    grid = capacity if capacity <= 2048 else 512
    lengths = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[int(x)] for x in lengths], dtype=np.int64)
    out: Plan = []
    q = -(-capacity // grid)
    cls = -(-lengths // q)
    given_away = int(((cls * q - lengths) * left).sum())
    # fillers: the shortest items, as many tokens as are given away (never more than a quarter of all)
    upto = np.cumsum(lengths * left)
    want = min(kept * given_away, upto[-1] / 4) if len(upto) else 0
    filler = np.where(upto <= want, left, 0)
    cut = int(np.searchsorted(upto, want))
    if cut < len(left) and want > 0:
        filler[cut] = min(int(left[cut]), max(0, int((want - (upto[cut - 1] if cut else 0)) // lengths[cut])))
    stock = left - filler
    sizes, at = np.unique(cls, return_inverse=True)
    need = np.bincount(at, weights=stock, minlength=len(sizes)).astype(np.int64)
    plans, _ = _program(sizes, need, capacity // q, rounds, eps, leave)
    # classes to lengths: per slot of a plan a run of items, mostly of one length
    queues = [[[int(lengths[i]), int(stock[i])] for i in np.flatnonzero(at == k) if stock[i]] for k in range(len(sizes))]
    for a, n in plans:
        for pattern, m in _exact(a, n, queues):
            _top_up(pattern, m, capacity - sum(x * c for x, c in pattern.items()), lengths, filler, out)
    rest = filler.copy()
    where = {int(x): i for i, x in enumerate(lengths)}
    for queue in queues:
        for length, count in queue:
            rest[where[length]] += count
    return out + _best_fit(lengths, rest, capacity)


def _exact(plan: np.ndarray, n: int, queues: list[list[list[int]]]) -> list[tuple[dict[int, int], int]]:
    """A plan of classes for n containers as patterns of exact lengths; takes the items from the queues."""
    runs = []  # per slot its segments (length, containers)
    for k in np.flatnonzero(plan):
        for _ in range(int(plan[k])):
            queue, todo, run = queues[k], n, []
            while todo:
                i = next((i for i, (_, c) in enumerate(queue) if c >= todo), None)
                if i is None:
                    i = max(range(len(queue)), key=lambda j: queue[j][1])
                take = min(todo, queue[i][1])
                run.append((queue[i][0], take))
                queue[i][1] -= take
                if not queue[i][1]:
                    queue.pop(i)
                todo -= take
            runs.append(run)
    ends = sorted({e for run in runs for e in np.cumsum([c for _, c in run]).tolist()})
    out, start = [], 0
    where = [[0, run[0][1]] for run in runs]  # per slot: segment and its end
    for e in ends:
        pattern: dict[int, int] = {}
        for j, run in enumerate(runs):
            if where[j][1] <= start:
                where[j][0] += 1
                where[j][1] += run[where[j][0]][1]
            length = run[where[j][0]][0]
            pattern[length] = pattern.get(length, 0) + 1
        out.append((pattern, e - start))
        start = e
    return out


def _top_up(pattern: dict[int, int], m: int, slack: int, lengths: np.ndarray, filler: np.ndarray, out: Plan) -> None:
    """m containers of one pattern with fillers in their slack: an exact one if there is, else the longest
    that leaves room for another, else the longest that fits."""
    todo = [(pattern, m, slack)]
    while todo:
        pattern, m, slack = todo.pop()
        fits = np.flatnonzero(filler[: np.searchsorted(lengths, slack, side="right")])
        if not len(fits):
            out.append((pattern, m, True))
            continue
        last = int(fits[-1])
        two = fits[: np.searchsorted(lengths[fits], slack - lengths[fits[0]], side="right")]
        i = last if lengths[last] == slack or not len(two) else int(two[-1])
        n = min(m, int(filler[i]))
        filler[i] -= n
        size = int(lengths[i])
        if n < m:
            todo.append((pattern, m - n, slack))
        todo.append((pattern | {size: pattern.get(size, 0) + 1}, n, slack - size))


def _fill(lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """A full container from what is left: the longest item, then ever the longest that still fits,
    spread over many lengths in proportion to what is left so that the pattern can be repeated."""
    config = np.zeros(len(lengths), dtype=np.int64)
    room = capacity
    first = int(np.flatnonzero(left)[-1])
    config[first] = 1
    room -= int(lengths[first])
    while room > 0:
        fits = np.flatnonzero((left > config) & (lengths <= room))
        if not len(fits):
            break
        # exact end if one exists, else the most plentiful of the longer half
        exact = fits[lengths[fits] == room]
        if len(exact):
            i = int(exact[0])
        else:
            upper = fits[lengths[fits] >= lengths[fits[-1]] / 2]
            two = upper[room - lengths[upper] >= lengths[fits[0]]]
            two = two if len(two) else fits[-1:]
            i = int(two[len(two) - 1 - int((left[two] // (config[two] + 1))[::-1].argmax())])  # the longest of equals
        config[i] += 1
        room -= int(lengths[i])
    return config


def items_of(lengths: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, pieces, size): a text beyond the capacity in full pieces and a rest."""
    pieces = F.ceil(F.col("tokens") / F.lit(capacity)).cast("int")
    return lengths.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select("doc_id", "piece", "pieces", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * F.lit(capacity)).cast("int").alias("size"))


def pack_documents(documents: DataFrame, pack_sizes: DataFrame, tokenizer: str = TOKENIZER, bucket_rows: int = 50_000) -> DataFrame:
    """(capacity_tokens, doc_id, piece, pieces, size, container): every token of every text in one container."""
    spark = documents.sparkSession
    schema = "capacity_tokens int, doc_id bigint, piece int, pieces int, size int, container bigint"
    capacities = sorted({r[0] for r in pack_sizes.select("capacity_tokens").where("capacity_tokens > 0").distinct().limit(101).collect()})
    if len(capacities) > 100 or (capacities and capacities[-1] > MAX_CAPACITY):
        raise ValueError(f"pack_sizes must hold at most 100 capacities of up to {MAX_CAPACITY} tokens")
    lengths = written(token_lengths(documents, tokenizer), "token-lengths")  # tokenised once, read for every capacity
    out = []
    for capacity in capacities:
        items = items_of(lengths, capacity)
        histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
        # slots: rank range of a length -> containers of one configuration
        rows, at, base = [], {}, 0
        for config, n in solve(histogram, capacity):
            for size, k in config.items():
                start = at.get(size, 0)
                rows.append((size, start, start + n * k, k, base))
                at[size] = start + n * k
            base += n
        if not rows:
            continue
        # rank within a length: counts of hash buckets give offsets, only buckets are ordered. The tables of
        # buckets and slots are bounded by lengths and configurations; AQE sees their size before it broadcasts
        dealt = spark.createDataFrame([(s, n // bucket_rows + 1) for s, n in histogram.items()], "size int, buckets bigint")
        placed = items.join(dealt, "size").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("buckets"))).drop("buckets")
        offsets = placed.groupBy("size", "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.sum("n").over(Window.partitionBy("size").orderBy("bucket")) - F.col("n")).drop("n")
        ranked = placed.withColumn("r", F.row_number().over(Window.partitionBy("size", "bucket").orderBy("doc_id", "piece")) - 1).join(offsets, ["size", "bucket"]).withColumn("rank", F.col("r") + F.col("offset")).drop("r", "offset", "bucket")
        # a rank finds its slot by an equal block of ranks: a length's ranks are cut into as many blocks as it has slots
        slots_of = Counter(r[0] for r in rows)
        width = {s: -(-histogram[s] // slots_of[s]) for s in at}
        blocks = [(s, b, low, high, each, base) for s, low, high, each, base in rows for b in range(low // width[s], (high - 1) // width[s] + 1)]
        slots = spark.createDataFrame(blocks, "size int, block bigint, low bigint, high bigint, each int, base bigint")
        wide = spark.createDataFrame(list(width.items()), "size int, width bigint")
        found = ranked.join(wide, "size").withColumn("block", F.expr("rank div width")).drop("width").join(slots, ["size", "block"]).where("rank >= low and rank < high")
        packed = found.select(F.lit(capacity).alias("capacity_tokens"), "doc_id", "piece", "pieces", "size", (F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("bigint").alias("container"))
        out.append(packed)
    if not out:
        return spark.createDataFrame([], schema)
    result = out[0]
    for p in out[1:]:
        result = result.unionByName(p)
    return result


def cut_documents(packed: DataFrame) -> DataFrame:
    """(capacity_tokens, doc_id) of the texts that had to be cut."""
    return packed.where("pieces > 1").select("capacity_tokens", "doc_id").distinct()


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers, tokens, unused share, the lower bound of containers and the gap to it, per capacity."""
    per = packed.groupBy("capacity_tokens", "container").agg(F.sum("size").alias("tokens"), F.count("*").alias("items"))
    return per.groupBy("capacity_tokens").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), (1 - F.sum("tokens") / (F.count("*") * F.col("capacity_tokens"))).alias("unused_share")).withColumn("bound", F.ceil(F.col("tokens") / F.col("capacity_tokens"))).withColumn("gap", F.col("containers") / F.col("bound") - 1)
