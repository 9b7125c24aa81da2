"""SentencePiece encoding and decoding: a shared-prefix Viterbi over the sorted trie of distinct marked words."""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import lean

MARK = "▁"
_MARK = MARK.encode()
#: A worker keeps codes of words up to about so many bytes, twice, and as much of verdicts on neighbouring pieces; the
#: codes that weren't asked for lately go first. Nothing depends on it but speed. Texts are coded so many bytes at a time.
KEPT_BYTES, STEP_BYTES = 24 << 20, 1 << 20
#: What an entry of either table costs besides its bytes, about.
_ENTRY, _VERDICT = 150, 90


def model_path(name: str = "piece_bpe_32k.model") -> str:
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)


class Pieces:
    """A vocabulary of pieces with scores, as a SentencePiece model file holds it (identity normalizer, dummy prefix,
    byte fallback).

    Encoding is a Viterbi pass over each marked word, whose state at a character is the best way to end a piece there.
    kind "unigram": the state holds the highest sum of scores; of equal ones, that of the longest last piece stays.
    kind "bpe": the path must be one that merging by score leaves, which holds if each two neighbours of it, encoded
    alone, stay apart; so the state at a character is the one piece that fits the state before it. A prefix has the
    same states in every word, which is what words that share it reuse.
    """

    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], bytes_at: list[int], kind: str = "bpe"):
        self.pieces, self.kind = pieces, kind
        self.ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        self.scores = scores
        self.byte = bytes_at
        raw = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(bytes_at):
            raw[i] = bytes([b])
        self.raw, self.raw_size = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        self.size = [len(p) for p in pieces]
        self.ending = ahocorasick.Automaton()  # all pieces that end at a character, the longest first
        for p, i in self.ids.items():
            self.ending.add_word(p, i)
        self.ending.make_automaton()
        self.chars = set("".join(self.ids))
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min((scores[i] for i in self.ids.values()), default=0.0) - 10.0
        # words end before a mark and at characters that no piece holds
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        if inner:
            raise ValueError("a piece spans words")
        self.words: dict[bytes, bytes] = {}
        self.earlier: dict[bytes, bytes] = {}  # the generation of words before
        self.words_size = 0
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        odd = "".join(map(re.escape, sorted(self.chars - {MARK})))
        self.unit = re.compile(f"{MARK}*[{odd}]+|{MARK}+|[^{odd}{MARK}]") if odd else re.compile(f"{MARK}+|[^{MARK}]")

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> "Pieces":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.vocab_size())
        names = [sp.id_to_piece(i) for i in n]
        at = {names[i]: i for i in n if sp.is_byte(i)}
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in n]
        return cls(names, [sp.get_score(i) for i in n], plain, [at[f"<0x{b:02X}>"] for b in range(256)], kind)

    def merged(self, word: str) -> list[int]:
        """The codes that merging leaves: the neighbours of highest joint score merge first, of equal ones the first."""
        if len(word) <= 16:
            return self._merged_short(word)
        part, left, right = list(word), list(range(-1, len(word) - 1)), list(range(1, len(word) + 1))
        queue: list = []

        def offer(i):
            j = right[i]
            if i >= 0 and j < len(part) and (k := self.ids.get(part[i] + part[j])) is not None:
                heapq.heappush(queue, (-self.scores[k], i, part[i], part[j]))

        for i in range(len(part) - 1):
            offer(i)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = right[i] if i < len(part) else len(part)
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j], right[i] = a + b, "", right[j]
            if right[i] < len(part):
                left[right[i]] = i
            offer(i)
            if left[i] >= 0:
                offer(left[i])
        return [self.ids[p] for p in part if p]

    def _merged_short(self, word: str) -> list[int]:
        part, ids, scores = list(word), self.ids, self.scores
        best = [ids.get(a + b, -1) for a, b in zip(part, part[1:])]
        while True:
            at, top = -1, None
            for i, k in enumerate(best):
                if k >= 0 and (top is None or scores[k] > top):
                    at, top = i, scores[k]
            if at < 0:
                return [ids[p] for p in part]
            part[at : at + 2] = [part[at] + part[at + 1]]
            del best[at]
            if at < len(best):
                best[at] = ids.get(part[at] + part[at + 1], -1)
            if at:
                best[at - 1] = ids.get(part[at - 1] + part[at], -1)

    def fits(self, a: int, b: int) -> bool:
        ok = self.pairs[a << 20 | b] = self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
        return ok

    def stands(self, a: int) -> bool:
        ok = self.alone[a] = self.merged(self.pieces[a]) == [a]
        return ok

    def encode_words(self, words) -> dict[str, tuple]:
        """Codes of distinct words. Sorted words are a walk through their trie, depth first: the states of the prefix
        that a word shares with the one before stay on the stack."""
        return self._merge_walk(words) if self.kind == "bpe" else self._score_walk(words)

    def _merge_walk(self, words) -> dict[str, tuple]:
        if len(self.pairs) * _VERDICT > KEPT_BYTES:
            self.pairs = {}
        out, pairs, alone, size, ending, reach = {}, self.pairs, self.alone, self.size, self.ending, self.longest - 1
        last, back = [0], [0]  # by end: the last piece, -1 if none fits, and where it starts
        before = ""
        for word in sorted(words):
            if word[:2] == MARK * 2:
                out[word] = tuple(self.merged(word))  # pieces of marks alone may tie in score
                continue
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], back[shared + 1 :]
            before, n = word, len(word)
            last += [-1] * (n - shared)
            back += [0] * (n - shared)
            for end, k in ending.iter(word, max(0, shared - reach)) if self.ids else ():
                end += 1
                if end <= shared or last[end] >= 0:
                    continue
                if start := end - size[k]:
                    if (prior := last[start]) < 0:
                        continue
                    if (ok := pairs.get(prior << 20 | k)) is None:
                        ok = self.fits(prior, k)
                elif (ok := alone.get(k)) is None:
                    ok = self.stands(k)
                if ok:
                    last[end], back[end] = k, start
            if last[n] < 0:
                out[word] = tuple(self.merged(word))
                continue
            codes, end = [], n
            while end:
                codes.append(last[end])
                end = back[end]
            codes.reverse()
            out[word] = tuple(codes)
        return out

    def _score_walk(self, words) -> dict[str, tuple]:
        out, ids, scores, longest = {}, self.ids, self.scores, self.longest
        start_of, code, best = [0], [-1], [0.0]  # by end: start of the last piece, its id, the sum of scores
        before = ""
        for word in sorted(words):
            shared = len(os.path.commonprefix((before, word)))
            del start_of[shared + 1 :], code[shared + 1 :], best[shared + 1 :]
            before = word
            for end in range(shared + 1, len(word) + 1):
                at, got, top = end - 1, -1, best[end - 1] + self.unknown
                for start in range(max(0, end - longest), end):
                    if (k := ids.get(word[start:end])) is not None and (got < 0 or best[start] + scores[k] > top):
                        at, got, top = start, k, best[start] + scores[k]
                start_of.append(at)
                code.append(got)
                best.append(top)
            path, end = [], len(word)
            while end:
                start = start_of[end]
                path.extend([code[end]] if code[end] >= 0 else [self.byte[b] for b in reversed(word[start:end].encode())])
                end = start
            out[word] = tuple(reversed(path))
        return out

    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        """Codes of each UTF-8 text; an empty one has none. Characters without a piece go by their bytes, as does the
        mark itself where a text holds it, so that decoding gives every text back.

        What stands between two spaces is coded once for all texts, with the mark before it."""
        if self.words_size > KEPT_BYTES:
            self.earlier, self.words, self.words_size = self.words, {}, 0
        out: list = [None] * len(raws)
        get, missing, later = self.words.get, set(), []
        for k, raw in enumerate(raws):
            if not raw:
                out[k] = b""
            elif raw[0] == 32 or b"  " in raw or _MARK in raw:
                out[k] = self._odd(raw)  # runs of marks, or marks of the text's own
            else:
                got = list(map(get, words := raw.split(b" ")))
                if None in got:
                    missing.update(w for w, g in zip(words, got) if g is None)
                    later.append((k, words))
                else:
                    out[k] = b"".join(got)
        if missing:
            for w in missing & self.earlier.keys():
                self._keep(w, self.earlier[w])
            self._learn(missing - self.words.keys())
            for k, words in later:
                out[k] = b"".join(map(self.words.__getitem__, words))
        return [np.frombuffer(x, np.int32) for x in out]

    def _keep(self, word: bytes, codes: bytes) -> None:
        self.words[word] = codes
        self.words_size += len(word) + len(codes) + _ENTRY

    def _learn(self, words: set[bytes]) -> None:
        units, whole = {}, self.chars.issuperset
        for w in words:
            word = MARK + w.decode()
            units[w] = (word,) if whole(word) else self.unit.findall(word)
        known = self._coded({u for us in units.values() for u in us})
        for w, us in units.items():
            self._keep(w, array("i", known[us[0]]).tobytes() if len(us) == 1 else b"".join([array("i", known[u]).tobytes() for u in us]))

    def _coded(self, units: set[str]) -> dict[str, tuple]:
        held = {u for u in units if u[0] in self.chars}
        return self.encode_words(held) | {u: tuple(self.byte[b] for b in u.encode()) for u in units - held}

    def _odd(self, raw: bytes) -> bytes:
        parts = [self.unit.findall(p) for p in self._parts(raw.decode())]
        known = self._coded({u for us in parts for u in us})
        codes: list[int] = []
        for k, us in enumerate(parts):
            codes += [self.byte[b] for b in _MARK] if k else []
            for u in us:
                codes += known[u]
        return np.array(codes, np.int32).tobytes()

    @staticmethod
    def _parts(text: str) -> list[str]:
        if not text:
            return [""]
        first, *rest = text.split(MARK)
        return [MARK + first.replace(" ", MARK), *(p.replace(" ", MARK) for p in rest)]

    def decode(self, codes: np.ndarray) -> bytes:
        """The UTF-8 text of codes."""
        if not len(codes):
            return b""
        size = self.raw_size[codes]
        stop = np.cumsum(size)
        at = np.arange(stop[-1]) + np.repeat(self.raw_start[codes] - stop + size, size)
        return self.raw[at][1:].tobytes()


_LOADED: dict = {}


def vocabulary(path: str, kind: str) -> Pieces:
    """A worker loads a model once and keeps its words from task to task."""
    if (path, kind) not in _LOADED:
        _LOADED[path, kind] = Pieces.load(path, kind)
    return _LOADED[path, kind]


def _steps(batch: pa.RecordBatch, column: str):
    """The batch in slices of 1024 rows at most, and of STEP_BYTES of text unless one text is longer."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < batch.num_rows:
        n = max(1, min(1024, int(np.searchsorted(np.cumsum(size[at : at + 1024]), STEP_BYTES, "right"))))
        yield batch.slice(at, n)
        at += n


def encode(docs: DataFrame, path: str | None = None, kind: str = "bpe", id_col: str = "doc_id", text_col: str = "text", tokens: bool = True) -> DataFrame:
    """(doc_id, text, tokens, n_tokens, n_byte_tokens, ids_sha256, restored) of every row, in one pass without shuffle.

    tokens: the codes; ids_sha256: of the codes as little-endian 32-bit integers; restored: whether decoding them gave
    the text back. A null text has null tokens, no count and the digest of none; an empty one has empty tokens. Rows
    of one id, or of null id, are coded each for itself; extra columns are ignored. With ``tokens`` False, neither
    text nor codes are returned.
    """
    where = path or model_path()
    columns = "doc_id bigint, " + "text string, tokens array<int>, " * tokens + "n_tokens bigint, n_byte_tokens bigint, ids_sha256 string, restored boolean"

    def run(batches):
        pieces = vocabulary(where, kind)
        low, high = min(pieces.byte), max(pieces.byte)
        for batch in batches:
            for part in _steps(batch, "text"):
                raws = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column("text")]
                codes = pieces.encode(raws)
                cols = {"doc_id": part.column("doc_id")}
                if tokens:
                    lists = [c if t.is_valid else None for c, t in zip(codes, part.column("text"))]
                    cols |= {"text": part.column("text"), "tokens": pa.array(lists, pa.list_(pa.int32()))}
                cols |= {
                    "n_tokens": pa.array([c.size for c in codes], pa.int64()),
                    "n_byte_tokens": pa.array([int(((c >= low) & (c <= high)).sum()) for c in codes], pa.int64()),
                    "ids_sha256": [hashlib.sha256(c.tobytes()).hexdigest() for c in codes],
                    "restored": [pieces.decode(c) == raw for c, raw in zip(codes, raws)],
                }
                yield pa.RecordBatch.from_pydict(cols)

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"`{text_col}` text").mapInArrow(lean(run), columns)


def op6(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens=False)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with the codes of its whole text, each for itself: null codes of a null text, none of an empty one. Rows of one
    id or of none stay; an empty table gives an empty one."""
    return encode(docs).select("doc_id", "tokens", "n_tokens", "ids_sha256", "restored")
