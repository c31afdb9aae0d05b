"""Benchmark decontamination with one Aho-Corasick automaton.

Words of texts and benchmark items: A-Z is lower-cased, words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A window is
WINDOW consecutive words of an item (all its words if it has fewer). The automaton holds each distinct window; its
letters are the numbers of the benchmark's words, so it has WINDOW nodes a window at most, held in flat arrays. A block
of texts is one line of word numbers, 0 for other words and between texts, and is scanned once: cut into lanes that all
take a step together, each from the WINDOW - 1 words before it. A match's end is a word number, and that gives the
offsets in the original text.

The automaton is built on each executor from the broadcast words. Their size is checked: items are dealt in pieces of
CHUNK words, and pieces beyond BLOCK_BYTES of words in all are split into blocks; the texts are then scanned once for
each block, one automaton at a time, and the hits of a block are written before the next one is built.

Edge cases: a null or blank text has no words and no hit; an item without words has no window; a null item id counts
as no item. Repeated items count once, repeated rows are judged alike, very long texts and items are taken whole. New
columns replace those of the same name, unless a prefix tells them apart. An empty benchmark hits nothing; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamcover.llm.common import add_columns, alnum_words, checkpointed, code_points, emit, free_prefix, quoted, read_table, shared, slices

WINDOW = 10
#: Bytes of benchmark words in one automaton, about; it takes some 45 times as much in each Python worker, 190 MB, and
#: 350 MB while it is built.
BLOCK_BYTES = 1 << 22
#: Words of an item in one piece, and the next WINDOW - 1.
CHUNK = 20_000
#: Words of a lane.
LANE = 256
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FIELDS = {"n_words": "long", "spans": "array<struct<start:long,end:long>>", "items": "array<string>", "n_hit": "long"}
#: Of one block: runs of hit words (past the last word) with their offsets, and the items.
HITS = {"runs": "array<struct<first:long,last:long,start:long,end:long>>", "items": "array<string>"}


class Automaton:
    """Aho-Corasick over sequences of numbers above 0: sequences (n, size), with 0 behind shorter ones.

    States are numbered level by level from the root, 0, and so are the sorted edges that lead to them.
    """

    def __init__(self, sequences: np.ndarray):
        n, self.size = sequences.shape
        self.edges, self.fail, self.length = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ends = np.zeros(n, np.int64)  # the state that each sequence ends in
        for k in range(self.size):
            live = np.flatnonzero(sequences[:, k])
            key = _edge(self.ends[live], sequences[live, k])
            edges, place = np.unique(key, return_inverse=True)
            first = len(self.fail)
            above = (edges >> np.uint64(32)).astype(np.int64)
            # a state's longest proper suffix goes on from that of the state above; from the root there is none
            self.fail = np.concatenate([self.fail, self.step(self.fail[above], (edges & np.uint64(0xFFFFFFFF)).astype(np.int64)) if k else np.zeros(len(edges), np.int64)])
            self.edges = np.concatenate([self.edges, edges])
            self.ends[live] = first + place.reshape(-1)
        self.length = np.zeros(len(self.fail), np.int64)
        self.length[self.ends] = (sequences > 0).sum(1)
        self.length[0] = 0
        # the next shorter sequence that ends where this one does, or where this state's suffix does
        self.shorter, at = np.zeros(len(self.fail), np.int64), self.fail.copy()
        for _ in range(self.size):
            self.shorter = np.where((self.shorter == 0) & (self.length[at] > 0), at, self.shorter)
            at = self.fail[at]

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """States after one letter each."""
        out = np.zeros(len(state), np.int64)
        live = np.flatnonzero(letter)
        state, letter = state[live], letter[live]
        while len(live) and len(self.edges):
            key = _edge(state, letter)
            i = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            there = self.edges[i] == key
            out[live[there]] = i[there] + 1
            again = ~there & (state > 0)
            live, state, letter = live[again], self.fail[state[again]], letter[again]
        return out

    def scan(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in a line of letters where sequences end, and the states there, the longest sequence's."""
        lead = self.size - 1
        lanes = -(-len(line) // LANE)
        padded = np.zeros(lead + lanes * LANE, np.int64)
        padded[lead : lead + len(line)] = line
        begins, state = np.arange(lanes) * LANE, np.zeros(lanes, np.int64)
        places, states = [], []
        for k in range(lead + LANE):
            state = self.step(state, padded[begins + k])
            if k >= lead:
                found = np.where(self.length[state] > 0, state, self.shorter[state])
                hit = np.flatnonzero(found)
                places.append(begins[hit] + k - lead)
                states.append(found[hit])
        places, states = np.concatenate(places), np.concatenate(states)
        order = np.argsort(places)
        return places[order], states[order]


def _edge(state: np.ndarray, letter: np.ndarray) -> np.ndarray:
    return state.astype(np.uint64) << np.uint64(32) | letter.astype(np.uint64)


class Matcher:
    """Finds the windows of a block of items, given as (item id, words)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int = WINDOW):
        self.number: dict[bytes, int] = {}
        rows, owner = [np.zeros((0, size), np.int64)], [np.zeros(0, np.int64)]
        self.names = sorted({name for name, _ in items})
        place = {name: k for k, name in enumerate(self.names)}
        for name, words in items:
            numbers = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64)
            if len(numbers):
                short = np.pad(numbers, (0, max(0, size - len(numbers))))
                rows.append(np.lib.stride_tricks.sliding_window_view(short, size))
                owner.append(np.full(len(rows[-1]), place[name]))
        self.automaton = Automaton(np.concatenate(rows))
        pairs = np.unique(self.automaton.ends * max(1, len(self.names)) + np.concatenate(owner))
        self.states, self.items = pairs // max(1, len(self.names)), pairs % max(1, len(self.names))

    def owners(self, state: int) -> list[str]:
        """Items with the window that ends in a state."""
        a, b = np.searchsorted(self.states, [state, state + 1])
        return [self.names[k] for k in self.items[a:b].tolist()]

    def hits(self, texts: list[list[bytes]]) -> list[tuple[list[list[int]], set[str]]]:
        """For each text's words: runs of hit words as [first, past the last], in order, and the items whose windows
        occur."""
        out: list[tuple[list[list[int]], set[str]]] = [([], set()) for _ in texts]
        if not len(self.states):
            return out
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes + 1) - sizes - 1
        line, get = np.zeros(int((sizes + 1).sum()), np.int64), self.number.get
        for words, a, n in zip(texts, starts.tolist(), sizes.tolist(), strict=True):
            line[a : a + n] = np.fromiter(map(get, words, repeat(0)), np.int64, n)
        places, states = self.automaton.scan(line)
        text = np.searchsorted(starts, places, side="right") - 1
        met: dict[int, set[int]] = defaultdict(set)
        ends = places - starts[text] + 1
        for i, state, end in zip(text.tolist(), states.tolist(), ends.tolist(), strict=True):
            runs, found = out[i]
            first = end - int(self.automaton.length[state])
            if runs and first <= runs[-1][1]:
                while len(runs) > 1 and first <= runs[-2][1]:
                    runs.pop()
                runs[-1] = [min(first, runs[-1][0]), end]
            else:
                runs.append([first, end])
            while state and state not in met[i]:  # its items are known, and those of the shorter ones
                met[i].add(state)
                found.update(self.owners(state))
                state = int(self.automaton.shorter[state])
        return out


def _offsets(text: bytes, runs: list[list[int]]) -> list[dict[str, int]]:
    """Runs of words as code points of the original text, end exclusive."""
    places = [m.span() for m in WORD.finditer(text.lower())]
    at = code_points(text, [x for a, b in runs for x in (places[a][0], places[b - 1][1])])
    return [{"start": a, "end": b} for a, b in zip(at[::2], at[1::2], strict=True)]


def joined(runs: list[list[int]]) -> list[list[int]]:
    """Runs [first, past the last] in order, those that overlap or touch as one."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def scan(df: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, item: str = "item_id", item_text: str = "text", size: int = WINDOW, prefix: str = "") -> DataFrame:
    """``df``'s kept columns with n_words, n_hit, items (sorted ids as text) and spans (hit runs, in code points)."""
    keep = df.columns if keep is None else keep
    known = _pieces(benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct(), size)
    total = known.agg(F.coalesce(F.sum(F.octet_length("w")), F.lit(0))).first()[0]
    n = 1 + total // BLOCK_BYTES
    if n > 1:
        return _scan_blocks(df, checkpointed(known), n, text, keep, size, prefix)
    matcher = _matcher(known, size)

    def run(texts):
        out: dict[str, list] = {k: [] for k in FIELDS}
        words = [alnum_words(t or b"") for t in texts]
        for t, own, (runs, found) in zip(texts, words, matcher().hits(words), strict=True):
            runs = joined(runs)
            values = len(own), _offsets(t, runs) if runs else [], sorted(found), sum(b - a for a, b in runs)
            for name, value in zip(FIELDS, values, strict=True):
                out[name].append(value)
        return out

    return add_columns(df, text, run, FIELDS, keep, prefix)


def _pieces(items: DataFrame, size: int) -> DataFrame:
    """(i, w): the items' words in pieces of CHUNK words, each with the ``size`` - 1 words behind it, so that every window
    of an item is in one piece."""

    def cut(batches):
        for batch in batches:
            for part, texts in slices(batch, "t"):
                names, pieces = [], []
                for name, text in zip(part.column(0).to_pylist(), texts, strict=True):
                    words = alnum_words(text)
                    for a in range(0, max(1, len(words) - size + 1), CHUNK):
                        names.append(name)
                        pieces.append(b" ".join(words[a : a + CHUNK + size - 1]))
                yield {"i": names, "w": pa.array(pieces, pa.binary())}

    return emit(items, cut, "i string, w binary")


def _matcher(pieces: DataFrame, size: int):
    return shared(pieces.sparkSession, ([(r.i, bytes(r.w).split()) for r in pieces.collect()], size), lambda x: Matcher(*x))


def _scan_blocks(df: DataFrame, known: DataFrame, n: int, text: str, keep: list[str], size: int, prefix: str) -> DataFrame:
    """The same for a benchmark of ``n`` blocks: each block's hits are joined to the texts by a row number."""
    fields = {prefix + name: kind for name, kind in FIELDS.items()}
    keep = [c for c in keep if c not in fields]
    own = free_prefix([*df.columns, *fields])
    row, runs, items = f"{own}row", f"{own}runs", f"{own}items"
    rows = checkpointed(df.select(*map(quoted, dict.fromkeys([*keep, text])), F.monotonically_increasing_id().alias(row)))
    hits = None
    for block in range(n):
        matcher = _matcher(known.where(F.pmod(F.xxhash64("i", "w"), F.lit(n)) == block), size)

        def run(texts, matcher=matcher):
            out: dict[str, list] = {k: [] for k in HITS}
            for t, (found, names) in zip(texts, matcher().hits([alnum_words(t or b"") for t in texts]), strict=True):
                found = joined(found)
                at = _offsets(t, found) if found else []
                out["runs"].append([{"first": a, "last": b, **o} for (a, b), o in zip(found, at, strict=True)])
                out["items"].append(sorted(names))
            return out

        part = checkpointed(add_columns(rows, text, run, HITS, [row], own).where(F.size(runs) > 0))
        hits = part if hits is None else hits.unionByName(part)
    found = hits.groupBy(row).agg(F.flatten(F.collect_list(runs)).alias(runs), F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items))
    counted = add_columns(rows, text, lambda texts: {"n_words": [len(alnum_words(t or b"")) for t in texts]}, {"n_words": "long"}, [*keep, row], prefix)
    whole = counted.join(found.withColumn(runs, _joined_runs(runs)), row, "left")
    new = {
        "n_words": F.col(f"{prefix}n_words"),
        "spans": F.coalesce(F.transform(runs, lambda r: F.struct(r.start.alias("start"), r.end.alias("end"))), F.array().cast(FIELDS["spans"])),
        "items": F.coalesce(items, F.array().cast(FIELDS["items"])),
        "n_hit": F.coalesce(F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"]), F.lit(0)),
    }
    return whole.select(*map(quoted, keep), *[new[name].alias(prefix + name) for name in FIELDS])


def _joined_runs(runs: str):
    """Runs of several blocks in order, those that overlap or touch as one."""

    @F.pandas_udf(HITS["runs"])
    def join(column: pd.Series) -> pd.Series:
        out = []
        for found in column:
            ends = {r["first"]: r["start"] for r in found}, {r["last"]: r["end"] for r in found}
            out.append([{"first": a, "last": b, "start": ends[0][a], "end": ends[1][b]} for a, b in joined([[r["first"], r["last"]] for r in found])])
        return pd.Series(out)

    return join(F.col(runs))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    own = free_prefix(docs.columns)
    found = scan(docs, read_table(spark, sf_dir, "benchmark"), prefix=own)
    return found.where(F.col(f"{own}n_hit") == 0).select(*map(quoted, docs.columns))
