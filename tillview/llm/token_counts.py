"""Token counts that follow edits.

Each document is cut into leaves of some hundred characters that end in white space, where tokens and
normalisation cannot reach across. A segment tree over the leaves holds the characters and the tokens
of every subtree. An edit finds its leaves by character position, encodes only their new text, with
the following leaf as context if the white space between them is gone, and updates the sums on the
way to the root.

Defined cases: a null text is an empty one; edits are applied in the coordinates of the original text,
clipped to it, and an edit that starts before the end of an earlier one is left out; null or empty edit
lists change nothing; other columns pass through, and input columns named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tillview.llm.common import add_columns, byte_words, worker_value
from tillview.llm.subwords import subword_coder, vocabulary_path

LEAF_CHARS = 512
SPACES = " \t\n\x0b\x0c\r"
ADDED = {
    "n_tokens": "long", "n_edits": "long", "n_tokens_after": "long", "n_chars_encoded": "long", "edited": "string",
}
EDITS = {"edit_starts": "array<long>", "edit_ends": "array<long>", "edit_texts": "array<string>"}
# What is taken out of a text before training: addresses, links and long numbers.
PRIVATE = (
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "[email]"),
    (r"https?://[^\s]+", "[link]"),
    (r"\+?\d[\d ()-]{6,}\d", "[number]"),
)


class CountTree:
    """Segment tree of a text's leaves with the characters and tokens below every node."""

    def __init__(self, text: str, count):
        import regex

        self.count = count
        blank = worker_value("blank", lambda: regex.compile(r"[\x20\x09-\x0D]+"))
        self.leaves, at = [], 0
        while at < len(text):
            gap = blank.search(text, min(at + LEAF_CHARS, len(text)))
            end = gap.end() if gap else len(text)
            self.leaves.append(text[at:end])
            at = end
        self.width = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.leaves += [""] * (self.width - len(self.leaves))
        self.chars = [0] * self.width + [len(leaf) for leaf in self.leaves]
        self.tokens = [0] * self.width + [count(leaf) for leaf in self.leaves]
        for node in range(self.width - 1, 0, -1):
            self.total(node)
        self.encoded = 0

    def total(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and its place in the leaf."""
        node = 1
        while node < self.width:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= self.chars[node]
                node += 1
        return node - self.width, at

    def put(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        node = leaf + self.width
        self.chars[node], self.tokens[node] = len(text), tokens
        while node > 1:
            node //= 2
            self.total(node)

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace the characters ``start`` to ``end``."""
        first, low = self.leaf_at(start)
        last, high = self.leaf_at(end)
        made = self.leaves[first][:low] + text + self.leaves[last][high:]
        # Without white space at its end, the text goes on in the next leaf that holds any.
        while not made.endswith(tuple(SPACES)) and last + 1 < self.width and self.chars[1]:
            last += 1
            made += self.leaves[last]
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self.put(leaf, "", 0)
        self.encoded += len(made)
        self.put(first, made, self.count(made))

    def text(self) -> str:
        return "".join(self.leaves)


def applicable(length: int, starts, ends, texts) -> list[tuple[int, int, str]]:
    """Edits in order, clipped to the text, without those that overlap an earlier one."""
    chosen, upto = [], 0
    for start, end, text in sorted(zip(starts or [], ends or [], texts or [], strict=True), key=lambda e: e[:2]):
        start, end = max(0, min(start, length)), max(0, min(end, length))
        if start >= upto and end >= start:
            chosen.append((start, end, text or ""))
            upto = end
    return chosen


def edit_token_counts(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with counts before and after the edits in its columns ``EDITS``, and the edited text."""
    path = path or vocabulary_path()

    def run(texts, starts, ends, replacements):
        coder = subword_coder(path)
        count = lambda part: sum(map(len, map(coder.__getitem__, byte_words(part))))
        rows = []
        for old, a, b, new in zip(*[c.to_pylist() for c in (texts, starts, ends, replacements)], strict=True):
            tree = CountTree(old or "", count)
            before = tree.tokens[1]
            edits = applicable(len(old or ""), a, b, new)
            # From the last to the first: positions before an edit stay as they are.
            for start, end, part in reversed(edits):
                tree.edit(start, end, part)
            rows.append((before, len(edits), tree.tokens[1], tree.encoded, tree.text()))
        return list(zip(*rows, strict=True))

    return add_columns(docs, [text, *EDITS], ADDED, run)


def private_edits(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with edits that replace addresses, links and long numbers by a mark."""

    def run(texts):
        import regex

        rules = [(regex.compile(pattern), mark) for pattern, mark in PRIVATE]
        columns = [], [], []
        for body in texts.to_pylist():
            found = sorted((m.start(), m.end(), mark) for rule, mark in rules for m in rule.finditer(body or ""))
            for column, values in zip(columns, zip(*found, strict=True) if found else ([], [], []), strict=True):
                column.append(list(values))
        return columns

    return add_columns(docs, [text], EDITS, run)
