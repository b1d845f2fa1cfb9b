"""Token counts by a linear longest-match automaton.

A trie over the vocabulary gets failure links: where the longest match can go no further, the link tells in which node the
text goes on once the longest piece (and perhaps more) has been popped, and how many pieces that were. So greedy
word-piece lengths take one pass over the characters, whatever the vocabulary, and no piece is ever built.

Words are cut at blanks and every other character but letters, digits and marks is a word by itself. A word without a
segmentation counts as one unknown token. Counts of short words are remembered, at most CACHE_MAX a worker.

Nulls and texts without words have no tokens. Texts of any length are counted whole, repeated rows get the same count, and an empty
table gives an empty result. One row per row of the input, nothing is shuffled; extra columns are not read, so they cannot clash."""

from __future__ import annotations

import json
from collections import Counter, deque

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.common import by_batch, held, id_and_text, raw_texts

WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+|[^\s\p{L}\p{N}\p{M}]")
CACHE_MAX = 300_000


class Automaton:
    """``initial``: pieces a word may start with; ``inner``: pieces that may follow."""

    NONE = -1

    def __init__(self, initial: set[str], inner: set[str]) -> None:
        # node 0: start of a word; node 1: start of a later piece
        self.next: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    if (to := self.next[node].get(c)) is None:
                        to = self.next[node][c] = len(self.next)
                        self.next.append({})
                        final.append(False)
                    node = to
                if node != root:
                    final[node] = True
        self.fail = [self.NONE] * len(self.next)
        self.pops = [0] * len(self.next)
        queue = deque((0, 1))
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                if final[v]:
                    self.fail[v], self.pops[v] = 1, 1
                else:
                    z, n = self.fail[u], self.pops[u]
                    while z != self.NONE and c not in self.next[z]:
                        n += self.pops[z]
                        z = self.fail[z]
                    if z != self.NONE:
                        self.fail[v], self.pops[v] = self.next[z][c], n
                queue.append(v)

    def count(self, word: str) -> int | None:
        """How many pieces greedy longest match gives; None if it gets stuck."""
        node, total, after, fail, pops = 0, 0, self.next, self.fail, self.pops
        for c in word:
            while (to := after[node].get(c)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return None
            node = to
        while node != 1:  # what is left is popped until nothing is
            total += pops[node]
            node = fail[node]
            if node < 0:
                return None if word else 0
        return total


def load(path: str) -> Automaton:
    """Word pieces from a byte-pair vocabulary with a word-start mark: marked tokens start words, the others follow.
    Single characters may do both, so that every word made of them can be cut."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    byte_of = _byte_letters()
    initial, inner = set(), set()
    for token in vocabulary:
        try:
            text = bytes(byte_of[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue  # a part of a character
        (initial if text[:1] == " " else inner).add(text.removeprefix(" "))
    single = {x for x in inner if len(x) == 1}
    return Automaton((initial | single) - {""}, inner - {""})


def _byte_letters() -> dict[str, int]:
    """The public byte-to-letter rule of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counting:
    """Words and tokens of texts; one per worker, so that the memory of short words is shared by its tasks."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.known: dict[bytes, tuple[int, int, int]] = {}

    def chunk(self, chunk: bytes) -> tuple[int, int, int]:
        """Words, tokens, unknown words of what stands between two blanks."""
        found = [self.automaton.count(w) for w in WORD.findall(chunk.decode("utf-8", "replace"))]
        out = len(found), sum(1 if n is None else n for n in found), sum(n is None for n in found)
        if len(chunk) < 48 and len(self.known) < CACHE_MAX:
            self.known[chunk] = out
        return out

    def text(self, text: bytes) -> tuple[int, int, int]:
        words = tokens = unknown = 0
        known, chunk = self.known, self.chunk
        for x, times in Counter(text.split()).items():
            w, t, u = known.get(x) or chunk(x)
            words += w * times
            tokens += t * times
            unknown += u * times
        return words, tokens, unknown


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown). ``vocabulary``: path of the vocabulary file, the same on every machine."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counting = held(("counting", vocabulary), lambda: Counting(load(vocabulary)))
        rows = [counting.text(t) for t in raw_texts(batch.column(1))]
        return pa.record_batch([batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return by_batch(id_and_text(docs), run, "doc_id long, n_words long, n_tokens long, n_unknown long")
