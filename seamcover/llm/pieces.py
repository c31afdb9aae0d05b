"""SentencePiece encoding and decoding by a shared-prefix Viterbi over a trie of sorted distinct words.

A text is marked as the library does it (one space put in front, each space written as U+2581) and cut into words
where no piece can cross: before a mark that follows another character, around a line feed unless a longer piece
holds one, and behind a letter before such characters as no piece has there. The distinct words of a block of texts that
aren't known yet are sorted; visiting them in that order walks their trie depth-first, and the lattice columns of the
prefix shared with the word before are kept as they are. Each column holds its best score and the last piece of that
path; a new character adds one column, from the pieces that end in it.

Two kinds of model, told by ``kind``. ``unigram``: the score is the sum of the pieces' log probabilities. ``bpe``: the
arc from a path's last piece to the next one has weight 0 if merging the two pieces' characters by rank yields just
these two, else minus infinity; only one path to a column survives, and it is the merge result. (Adding scores of a
merge-ranked vocabulary would not give that model's ids.) The pieces of a run of marks share one rank and break ties by
position, which no such arc can tell; so the columns over a word's leading marks hold the merge of just these marks, one
for each length of a run, and the arcs go on from there.

Characters without a piece become their UTF-8 bytes' pieces. Control pieces are never produced, and their names in a
text are ordinary text. Decoding joins the pieces, bytes included, and takes the mark in front away: texts come back
exactly, but that U+2581 itself comes back as a space, as in the library.

Edge cases: a null text gives null ids, an empty one no ids. Repeated rows are encoded alike. A word of any length takes
memory in proportion to it, with or without spaces. Kept columns of the results' names are replaced. An empty table
gives no rows.
"""

from __future__ import annotations

import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamcover.llm.common import add_columns, read_table, shared

MARK = "▁"
#: Words met in two blocks in a row whose ids a worker keeps, and pairs of pieces; more are forgotten all at once.
KEPT_WORDS = 200_000
KEPT_PAIRS = 400_000
#: A word of more characters is encoded in linear memory and not kept.
KEPT_CHARS = 200
#: The vocabulary file of the box that this operator reads; another path can be given.
VOCABULARY = "piece_bpe_32k.model"


class Codec:
    """A model's pieces, its encoder and decoder."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind, n = kind, model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        self.id = {names[i]: i for i in usual}
        self.score = {i: model.get_score(i) for i in usual}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.longest = max((len(p) for p in self.id), default=1)
        self.inside = {c for p in self.id if len(p) > 1 for c in p}
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a mark behind another character")
        words = f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if "\n" not in self.inside else f"{MARK}*[^{MARK}]+|{MARK}+"
        self.words = re.compile(words)
        # no piece goes on behind a letter with one of these
        apart = {c for c in self.id if len(c) == 1 and not c.isalnum()} - {b for p in self.id for a, b in zip(p, p[1:], strict=False) if a.isalpha()} - {MARK}
        self.tail = re.compile(rf"(?<=[^\W\d_])(?=[{''.join(map(re.escape, sorted(apart)))}])") if apart else None
        self.valid: dict[int, bool] = {}  # by first piece << 32 | second
        self.kept: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.symbols: dict[int, str] = {i: p for p, i in self.id.items()}
        self.tails: dict[str, int] = {p[i:]: -1 for p in self.id for i in range(1, len(p))} | self.id
        self.packed = [array("i", [i]).tobytes() for i in range(n)]
        self.lead = max((len(p) - len(p.lstrip(MARK)) for p in self.id if p.lstrip(MARK)), default=0)
        self.runs: list[tuple[int, bytes]] = [(0, b"")]

    # the symbols of a path: piece ids, and characters without a piece as -1 - code point

    def merge(self, word: str) -> list[int]:
        """Merges by rank, leftmost first among equals."""
        ids, parts = self.id, list(word)
        if len(parts) <= 32:
            get, score = ids.get, self.score
            while len(parts) > 1:
                best, at = None, 0
                for i in range(len(parts) - 1):
                    k = get(parts[i] + parts[i + 1])
                    if k is not None and (best is None or score[k] > best):
                        best, at = score[k], i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [ids.get(p, -1 - ord(p[0])) for p in parts]
        following, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def offer(i: int) -> None:
            j = following[i]
            if j < len(parts) and (k := ids.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-self.score[k], i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = following[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b or not a or not b:
                continue
            parts[i], parts[j] = a + b, ""
            following[i] = following[j]
            if following[i] < len(parts):
                before[following[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [ids.get(p, -1 - ord(p[0])) for p in parts if p]

    def run(self, n: int) -> tuple[int, bytes]:
        """Last piece and ids of a run of ``n`` marks."""
        while len(self.runs) <= n:
            self.runs.append(self._run(len(self.runs)))
        return self.runs[n]

    def _run(self, n: int) -> tuple[int, bytes]:
        ids = self.merge(MARK * n)
        return ids[-1], b"".join([self.packed[k] if k >= 0 else self._fallback(chr(-1 - k)) for k in ids])

    def pair(self, a: int, b: int) -> bool:
        """Whether the characters of two symbols merge to just these two."""
        if a < 0 or b < 0:
            return True
        known = self.merge(self.symbols[a] + self.symbols[b]) == [a, b]
        if len(self.valid) > KEPT_PAIRS:
            self.valid.clear()
        self.valid[a << 32 | b] = known
        return known

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids (int32) of sorted distinct words; columns of shared prefixes are computed once."""
        out: dict[str, bytes] = {}
        longest, pair, score = self.longest + 1, self.pair, self.score
        bpe, tails, valid, packed = self.kind == "bpe", self.tails.get, self.valid.get, self.packed
        last: list[int] = [0]  # column i: last symbol of the best path over the first i characters
        path: list[bytes] = [b""]  # the ids of that path
        total: list[float] = [0.0]  # and its score
        previous = ""
        for word in words:
            if len(word) > KEPT_CHARS:
                out[word] = self._encode_long(word)
                continue
            common = 0
            for a, b in zip(word, previous, strict=False):
                if a != b:
                    break
                common += 1
            del last[common + 1 :], path[common + 1 :], total[common + 1 :]
            marks = len(word) - len(word.lstrip(MARK)) if bpe else 0
            for i in range(common + 1, marks + 1):
                symbol, ids = self.run(i)
                last.append(symbol)
                path.append(ids)
                total.append(0.0)
            for i in range(max(common, marks) + 1, len(word) + 1):
                best, begin, sum_ = -1, i - 1, -1e300
                for j in range(i - 1, max(-1, i - longest), -1):
                    k = tails(word[j:i])
                    if k is None:  # no piece ends like this
                        break
                    if k < 0:  # a longer one does
                        continue
                    if not bpe:
                        if (s := total[j] + score[k]) > sum_:
                            best, begin, sum_ = k, j, s
                    elif not j or (x if (x := valid(last[j] << 32 | k)) is not None else pair(last[j], k)):
                        best, begin, sum_ = k, j, 0.0
                        break
                if best >= 0:
                    path.append(path[begin] + packed[best])
                else:  # a character without a piece
                    sum_ = total[i - 1] - 1e6
                    path.append(path[i - 1] + self._fallback(word[i - 1]))
                last.append(best)
                total.append(sum_)
            out[word] = path[-1]
            previous = word
        return out

    def _encode_long(self, word: str) -> bytes:
        """The same for one word, with a symbol and a back pointer a column, followed once at the end."""
        longest, score, bpe, tails, valid = self.longest + 1, self.score, self.kind == "bpe", self.tails.get, self.valid.get
        marks = len(word) - len(word.lstrip(MARK)) if bpe else 0
        last, back, total = (array(code, [0]) * (marks + 1) for code in "iid")
        for i in range(max(1, marks - self.lead), marks + 1):  # no other column of the run has a piece that leaves it
            last[i] = self._run(i)[0]
        for i in range(marks + 1, len(word) + 1):
            best, begin, sum_ = -1, i - 1, -1e300
            for j in range(i - 1, max(-1, i - longest), -1):
                k = tails(word[j:i])
                if k is None:
                    break
                if k < 0:
                    continue
                if not bpe:
                    if (s := total[j] + score[k]) > sum_:
                        best, begin, sum_ = k, j, s
                elif not j or (x if (x := valid(last[j] << 32 | k)) is not None else self.pair(last[j], k)):
                    best, begin, sum_ = k, j, 0.0
                    break
            last.append(best)
            back.append(begin)
            total.append(sum_ if best >= 0 else total[i - 1] - 1e6)
        out, i = [], len(word)
        while i > marks:
            out.append(self.packed[last[i]] if last[i] >= 0 else self._fallback(word[i - 1]))
            i = back[i]
        return (self._run(i)[1] if i else b"") + b"".join(reversed(out))

    def _fallback(self, char: str) -> bytes:
        return array("i", [self.byte[b] for b in char.encode("utf-8", "replace")]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32."""
        cut = [self.words.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        words = {w for ws in cut for w in ws}
        here = {w: self.kept[w] for w in words.intersection(self.kept)}
        again = {w: self.recent[w] for w in words.intersection(self.recent)}
        if len(self.kept) + len(again) > KEPT_WORDS:
            self.kept.clear()
        self.kept.update(again)
        here.update(again)
        split = self.tail.split if self.tail else lambda w: [w]
        new = {w: split(w) for w in words if w not in here}
        packed = self.encode_words(sorted({p for parts in new.values() for p in parts}))
        fresh = {w: b"".join([packed[p] for p in parts]) for w, parts in new.items()}
        here.update(fresh)
        self.recent = {w: s for w, s in fresh.items() if len(w) <= KEPT_CHARS}
        return [b"".join(map(here.__getitem__, ws)) for ws in cut]

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the ids' text."""
        line = b"".join(map(self.bytes.__getitem__, ids))
        return line[1:] if line[:1] == b" " else line


def _vocabulary(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return path


def _lists(ids: list[bytes | None]) -> pa.Array:
    sizes = np.array([len(x or b"") // 4 for x in ids], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([*[x is None for x in ids], False]))
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(x or b"" for x in ids), np.int32)))


def encode(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, kind: str = "bpe", name: str = "ids") -> DataFrame:
    """``df``'s kept columns and the ids of the text. path: of the model, on every executor."""
    codec = shared(df.sparkSession, (_vocabulary(path), kind), lambda x: Codec(*x))

    def run(texts):
        known = [i for i, t in enumerate(texts) if t is not None]
        ids: list[bytes | None] = [None] * len(texts)
        for i, x in zip(known, codec().encode([texts[i].decode("utf-8", "replace") for i in known]), strict=True):
            ids[i] = x
        return {name: _lists(ids)}

    return add_columns(df, text, run, {name: "array<int>"}, keep)


def decode(df: DataFrame, ids: str = "ids", name: str = "text", path: str | None = None, kind: str = "bpe") -> DataFrame:
    """``df`` with the text of its ids; null for null."""
    codec = shared(df.sparkSession, (_vocabulary(path), kind), lambda x: Codec(*x))

    @F.pandas_udf("string")
    def run(column):
        return column.map(lambda x: None if x is None else codec().decode(x.tolist()).decode("utf-8", "replace"))

    return df.withColumn(name, run(F.col(ids)))


def encoded(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None, kind: str = "bpe") -> DataFrame:
    """``df``'s kept columns with ids, n_tokens, and whether decoding gives the text back."""
    codec = shared(df.sparkSession, (_vocabulary(path), kind), lambda x: Codec(*x))

    def run(texts):
        c = codec()
        known = [i for i, t in enumerate(texts) if t is not None]
        ids: list[bytes | None] = [None] * len(texts)
        same: list[bool | None] = [None] * len(texts)
        for i, x in zip(known, c.encode([texts[i].decode("utf-8", "replace") for i in known]), strict=True):
            ids[i] = x
            same[i] = c.decode(np.frombuffer(x, np.int32).tolist()) == texts[i].replace(MARK.encode(), b" ")
        return {"ids": _lists(ids), "n_tokens": [None if x is None else len(x) // 4 for x in ids], "round_trip": same}

    return add_columns(df, text, run, {"ids": "array<int>", "n_tokens": "long", "round_trip": "boolean"}, keep)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as ids: doc_id, lang, source, ids, n_tokens, round_trip."""
    return encoded(docs, keep=[c for c in ("doc_id", "lang", "source") if c in docs.columns])
