"""Edit-aware token counts.

A text's pre-tokens stand in the leaves of a segment tree, some in each leaf, with that leaf's text, their
lengths and token counts; inner nodes hold sums. An edit is found by descending the sums. From shortly before
the edit, the pattern is matched anew on the edited text until a boundary falls on an old one behind the edit;
only these pre-tokens are encoded, and only the leaves that held them and the sums above are written again.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from textweave.llm.common import table

#: Byte-level BPE ranks, one "base64 rank" a line.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-token pattern that these ranks are made for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A match looks at most at three characters behind its end, so pre-tokens that end this far before an edit stay.
CONTEXT = 4
LEAF = 64
#: Characters that are cut into pre-tokens at once.
WINDOW = 1 << 17
#: Edits with so few characters between them are made as one.
NEAR = 16
#: What a cleaning pass shortens: long digit runs and runs of marks.
EDITS = regex.compile(r"[0-9]{12,}|([!#$%&*=_~-])\1+")


class Counter:
    """Tokens of a pre-token; counts of short ones are remembered, ``most`` of them at a time (some 100 bytes each)."""

    def __init__(self, ranks: str = RANKS, pattern: str = PATTERN, most: int = 100_000):
        with open(ranks, "rb") as f:
            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_, special_tokens={})
        self.pattern, self.seen, self.most = regex.compile(pattern), {}, most

    def count(self, piece: str) -> int:
        n = self.seen.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.seen) >= self.most:
                self.seen.clear()
            if len(piece) < 32:
                self.seen[piece] = n
        return n

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of ``text``, a window's at a time; one that ends near the end of its window is cut again in the next."""
        at, width = 0, WINDOW
        while at < len(text):
            end = min(len(text), at + width)
            found = self.pattern.findall(text, at, end)
            if end < len(text):
                reached = end
                while found and reached > end - CONTEXT:
                    reached -= len(found.pop())
                if not found:  # one pre-token fills the window
                    width *= 2
                    continue
            else:
                reached = end
            yield found
            at, width = reached, WINDOW


@lru_cache(maxsize=2)
def counter_of(ranks: str, pattern: str) -> Counter:
    """One for all tasks of a process."""
    return Counter(ranks, pattern)


class TokenTree:
    """Lengths and counts stand in arrays of integers; the tree above them is built at the first edit."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self._text = counter, text
        self.lengths, self.counts = array("i"), array("i")
        for pieces in counter.pieces(text):
            self.lengths.extend(map(len, pieces))
            self.counts.extend(map(counter.count, pieces))
        self.leaves: list[tuple[str, array, array]] = []

    def _grow(self) -> None:
        at = 0
        for i in range(0, max(1, len(self.lengths)), LEAF):
            lengths = self.lengths[i : i + LEAF]
            end = at + sum(lengths)
            self.leaves.append((self._text[at:end], lengths, self.counts[i : i + LEAF]))
            at = end
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (_, lengths, counts) in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(lengths), sum(counts)
        for node in range(self.size - 1, 0, -1):
            self._sum(node)
        self._text, self.lengths, self.counts = "", array("i"), array("i")

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1] if self.leaves else sum(self.counts)

    @property
    def text(self) -> str:
        return "".join(leaf[0] for leaf in self.leaves) if self.leaves else self._text

    def _find(self, at: int) -> tuple[int, int, int]:
        """Leaf, place in it and start of the pre-token that holds character ``at``; of the last one if it is the end."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        leaf = node - self.size
        lengths = self.leaves[leaf][1]
        place = 0
        while place + 1 < len(lengths) and at - start >= lengths[place]:
            start += lengths[place]
            place += 1
        return leaf, place, start

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in the place of characters start to end; the number of pre-tokens encoded."""
        if not self.leaves:
            self._grow()
        leaf, place, first = self._find(max(0, start - CONTEXT))
        skip = sum(self.leaves[leaf][1][:place])
        held, behind = [self.leaves[leaf][0][skip:]], leaf + 1
        reach, want = len(held[0]), end - first + CONTEXT
        while True:
            while behind < len(self.leaves) and reach < want:
                held.append(self.leaves[behind][0])
                reach += len(held[-1])
                behind += 1
            old = "".join(held)
            found = self._matched(old[: start - first] + new + old[end - first :], leaf, place, start - first + len(new), len(new) - (end - start), behind == len(self.leaves))
            if found:
                break
            want = 2 * reach + LEAF  # no common boundary in this part of the text
        lengths, counts, last_leaf, last_place = found
        fresh = old[: start - first] + new + old[end - first :]
        put = fresh[: sum(lengths)]
        for i in range(leaf, min(last_leaf + 1, len(self.leaves))):
            text, lens, toks = self.leaves[i]
            low = place if i == leaf else 0
            high = last_place if i == last_leaf else len(lens)
            cut = (sum(lens[:low]), sum(lens[:high]))
            lens[low:high], toks[low:high] = (lengths, counts) if i == leaf else (array("i"), array("i"))
            self.leaves[i] = (text[: cut[0]] + (put if i == leaf else "") + text[cut[1] :], lens, toks)
            node = self.size + i
            self.chars[node], self.tokens[node] = sum(lens), sum(toks)
            while node > 1:
                node //= 2
                self._sum(node)
        return len(lengths)

    def _matched(self, text: str, leaf: int, place: int, behind: int, shift: int, whole: bool) -> tuple[array, array, int, int] | None:
        """New lengths and counts of ``text`` up to the first boundary from ``behind`` on that is an old one, and that one's leaf and place; None if ``text``, which isn't ``whole``, has none."""
        lengths, counts, old = array("i"), array("i"), 0  # old: the old boundary that has been reached
        for m in self.counter.pattern.finditer(text):
            if not whole and m.end() > len(text) - CONTEXT:
                return None
            lengths.append(m.end() - m.start())
            counts.append(self.counter.count(m.group()))
            while old < m.end() - shift and leaf < len(self.leaves):
                if place < len(self.leaves[leaf][1]):
                    old += self.leaves[leaf][1][place]
                    place += 1
                else:
                    leaf, place = leaf + 1, 0
            if m.end() >= behind and old == m.end() - shift:
                return lengths, counts, leaf, place
        return (lengths, counts, len(self.leaves), 0) if whole else None  # no boundary in common: all the rest is new


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Runs of 12 digits and more become "0", runs of one mark that mark."""
    return [(m.start(), m.end(), m.group(1) or "0") for m in EDITS.finditer(text)]


def merged(text: str, edits: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The same edits with neighbours joined, the text between them unchanged."""
    out: list[tuple[int, int, str]] = []
    at, parts, last = 0, [], -1
    for start, end, new in edits:
        if last < 0 or start - last > NEAR:
            if last >= 0:
                out.append((at, last, "".join(parts)))
            at, parts = start, []
        else:
            parts.append(text[last:start])
        parts.append(new)
        last = end
    return [*out, (at, last, "".join(parts))] if edits else out


def count_tokens(docs: DataFrame, edits: Callable[[str], list[tuple[int, int, str]]] = cleaning_edits, ranks: str = RANKS, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: the id, ``n_tokens``, ``n_edits``, ``n_reencoded`` pre-tokens, and ``n_tokens_edited``.

    ``edits`` gives (start, end, replacement) of a text, in order, not overlapping. Whole texts are
    counted, in memory of some bytes a character whatever their length; null is empty, with no tokens.
    Rows are read one by one, so repeated rows and ids don't matter, and other columns aren't read.
    An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(ranks, pattern)
        for batch in batches:
            told = [array("q") for _ in range(4)]
            for text in batch.column(1):
                text = text.as_py() or ""
                tree = TokenTree(text, counter)
                before, changes, encoded = tree.total, edits(text), 0
                for start, end, new in reversed(merged(text, changes)):
                    encoded += tree.replace(start, end, new)
                for column, value in zip(told, (before, len(changes), encoded, tree.total), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in told]], [id_col, "n_tokens", "n_edits", "n_reencoded", "n_tokens_edited"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens long, n_edits long, n_reencoded long, n_tokens_edited long")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Each document's tokens, before and after ``cleaning_edits``; as ``count_tokens``."""
    return count_tokens(table(spark, sf_dir, "documents"))
