"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens: its states are the tokens read last, and an arc (l, r) exists if token r may follow token l
in an encoding. It starts with an arc from each byte to each byte. Merge k, of (a, b) into c, is applied as a gadget, in
the order of the merges:

* the arc (a, b) goes, since that pair merges;
* a new state c takes over the arcs that b has at that time, before the removal;
* each state with an arc to a that is still there gets an arc to c.

A sequence of tokens is an encoding if and only if the automaton has its arcs, and each text has exactly one. With tens
of thousands of merges the arcs are too many to list, billions, so they are held as gadgets: whether an arc is there follows
from one older arc, down to bytes, in as many steps as its tokens have merges.

All of this is compiled into tables before the first text: the gadget of each state (when it was made, and of which two),
the merges by pair, and the labels of the arcs as a deterministic automaton over bytes (Aho and Corasick), with the
transitions from each node, the node to go on from where there is none, and the tokens that can end at a node, the longest
first. Their size depends on the vocabulary only. Words are read byte by byte through them. Each place in a word has
exactly one state, that of the last token up to it, so the ids are found by going back from the end.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from itertools import chain

from pyspark.sql import DataFrame

from tessera.llm.common import map_texts

#: Up to this character all versions of Unicode agree on what letters, numbers and spaces are. Texts with others are split
#: by the library.
AGREED = 0x557
#: Words whose ids a worker keeps, twice over, and arcs that it keeps before it starts anew.
KEPT_WORDS, KEPT_STEPS = 100_000, 200_000


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves, the others for
    characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def splitter() -> re.Pattern:
    """How byte-level vocabularies split text before the merges: contractions; letters, numbers or others with a space
    before them; white space, but for the last space before a word. For texts up to AGREED, in classes of characters that
    the standard library's patterns take more quickly than Unicode properties."""

    def of(kind: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(AGREED + 1) if unicodedata.category(chr(c))[0] == kind)

    letters, numbers, space = of("L"), of("N"), "\t-\r \x85\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


#: The transitions of a node at which all labels end.
_NO_STEPS: dict[int, int] = {}


class Automaton:
    """The tokenization automaton of a tokenizer file's text (the JSON of the tokenizers library: byte-level BPE)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, pre, byte = spec["model"], spec.get("pre_tokenizer") or {}, byte_letters()
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only plain byte-level BPE files are supported")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that strip, match words or are normalized are not supported")
        vocab, n = model["vocab"], max([*model["vocab"].values(), *self.added.values()]) + 1
        self.labels: dict[int, bytes] = {i: bytes(byte[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        self.digits = [str(i) for i in range(n)]
        # the gadgets: when each state was made (-1: it is none), and of which two; when each pair was merged
        self.born, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        for t, i in vocab.items():
            if len(t) == 1:
                self.born[i] = 0
        self.merged: dict[int, int] = {}
        for k, pair in enumerate(model["merges"], 1):
            x, y = pair.split(" ") if isinstance(pair, str) else pair
            a, b, c = vocab[x], vocab[y], vocab[x + y]
            live = self.arc(a, b, k - 1)  # else no text ever reaches this merge, and the gadget changes nothing
            self.merged.setdefault(a << 32 | b, k)
            if live and self.born[c] < 0:
                self.born[c], self.left[c], self.right[c] = k, a, b
        self.last = len(model["merges"])
        self.sizes = [len(self.labels.get(i, b"")) for i in range(n)]
        self._compile_labels([i for i in range(n) if self.born[i] >= 0])
        self.kept: list[dict[int, bool]] = []
        self.asked = 0
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.split = splitter().findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._library = None

    def _compile_labels(self, states: list[int]) -> None:
        """The tables of the automaton over bytes: steps (by node, the transitions by byte), beyond (the node of the longest proper
        ending of a node's bytes that begins a label), and ends (the tokens that can end at a node, the longest first, each
        with its length and the states that it was asked to follow). Nodes are numbered by length, so that each one's
        ending comes before it."""
        self.steps: list[dict[int, int]] = [{}]
        self.beyond, self.ends = [0], [()]
        level = {0: [(self.labels[i], i) for i in states]}  # the labels that go on from each node
        depth = 0
        while level:
            deeper: dict[int, list[tuple[bytes, int]]] = {}
            for node, labels in level.items():
                for label, i in labels:
                    to = self.steps[node].get(label[depth])
                    if to is None:
                        to = self.steps[node][label[depth]] = len(self.beyond)
                        self.steps.append(_NO_STEPS)
                        self.beyond.append(self.next(self.beyond[node], label[depth]) if node else 0)
                        self.ends.append(self.ends[self.beyond[to]])
                    if len(label) == depth + 1:
                        self.ends[to] = ((i, len(label), {}), *self.ends[self.beyond[to]])
                    else:
                        if self.steps[to] is _NO_STEPS:
                            self.steps[to] = {}
                        deeper.setdefault(to, []).append((label, i))
            level, depth = deeper, depth + 1

    def next(self, node: int, byte: int) -> int:
        """The transition from a node by a byte. Each byte is a token, so that the first node has one for all."""
        while (to := self.steps[node].get(byte)) is None:
            node = self.beyond[node]
        return to

    def arc(self, a: int, b: int, k: int) -> bool:
        """Whether b may follow a after the first k gadgets. Both states must be there by then."""
        born, merged = self.born, self.merged
        while True:
            if merged.get(a << 32 | b, k + 1) <= k:
                return False
            x, y = born[a], born[b]
            if x == 0 and y == 0:
                return True
            if x > y:  # a took over the arcs of its right part
                a, k = self.right[a], x - 1
            elif y > x:  # the arc to b was added where there was one to its left part
                b, k = self.left[b], y
            else:
                a, b, k = self.right[a], self.left[b], x - 1

    def _ask(self, before: int, token: int, known: dict[int, bool]) -> bool:
        """Whether a token may follow a state; kept with what it was asked before."""
        if self.asked >= KEPT_STEPS:
            for k in self.kept:
                k.clear()
            self.kept, self.asked = [], 0
        if not known:
            self.kept.append(known)
        self.asked += 1
        found = known[before] = self.arc(before, token, self.last)
        return found

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of a word: one transition for each byte, which gives the tokens that can end there; the one that may
        follow the state where it begins is the state at this place. Then back from the last state, token by token."""
        text = word.encode("utf-8", "surrogatepass")
        states, node, place = [-1], 0, 0
        sizes, ends, steps, beyond = self.sizes, self.ends, self.steps, self.beyond
        for byte in text:
            place += 1
            while (to := steps[node].get(byte)) is None:
                node = beyond[node]
            node = to
            for token, size, known in ends[node]:
                before = states[place - size]
                if before < 0:
                    break
                found = known.get(before)
                if found is None:
                    found = self._ask(before, token, known)
                if found:
                    break
            states.append(token)
        ids = []
        while place:
            token = states[place]
            ids.append(token)
            place -= sizes[token]
        ids.reverse()
        return tuple(ids)

    def _words_of(self, text: str) -> list[str]:
        if ord(max(text)) <= AGREED:
            return self.split(text)
        if self._library is None:
            from tokenizers import pre_tokenizers

            self._library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; added tokens in it become their ids. Null counts as empty."""
        ids: list[int] = []
        for k, piece in enumerate(self.cut.split(text) if self.cut and text else [text]):
            if k % 2:
                ids.append(self.added[piece])
            elif piece:
                words = self._words_of(piece)
                found = list(map(self.words.get, words))
                for i, got in enumerate(found):
                    if got is None:
                        found[i] = self._new_word(words[i])
                ids.extend(chain.from_iterable(found))
        return ids

    def _new_word(self, word: str) -> tuple[int, ...]:
        """Ids of a word that was not asked for lately, which are then kept."""
        known = self.words
        got = known.get(word) or self.older.get(word) or self.encode_word(word)
        if len(word) <= 64:
            if len(known) >= KEPT_WORDS:  # what was not asked for since the last time goes
                self.older, self.words = known, {}
                known = self.words
            known[word] = got
        return got

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs one after the other, as text; bytes that are no UTF-8 become U+FFFD."""
        labels = self.labels
        return b"".join([labels[i] for i in ids]).decode("utf-8", "replace")


_compiled: dict[str, Automaton] = {}


def automaton(source: str) -> Automaton:
    """The automaton of a tokenizer file's text, compiled once in each process."""
    key = hashlib.sha256(source.encode()).hexdigest()
    if key not in _compiled:
        _compiled.clear()
        _compiled[key] = Automaton(source)
    return _compiled[key]


def load(path: str) -> str:
    """A tokenizer file's text, read on the driver; its size is that of a vocabulary, so it is broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_texts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each whole text. Null and empty texts have no ids. Rows that repeat come back each;
    an empty table gives no rows; other columns are ignored."""
    source = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def start():
        a = automaton(source.value)
        return lambda texts: [[a.encode(t) for t in texts]]

    return map_texts(docs, id_col, text_col, {"ids": "array<int>"}, start)


def decode_ids(encoded: DataFrame, tokenizer: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for each row of ids; null ids give an empty text."""
    source = encoded.sparkSession.sparkContext.broadcast(tokenizer)

    def start():
        a = automaton(source.value)
        return lambda rows: [[a.decode(ids or []) for ids in rows]]

    return map_texts(encoded, id_col, ids_col, {"text": "string"}, start)


def round_trip(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256 (of the decoded text) for each
    whole text, encoded and decoded in one pass, so that ids need not travel. Null counts as empty; see encode_texts."""
    source = docs.sparkSession.sparkContext.broadcast(tokenizer)
    sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()

    def start():
        a = automaton(source.value)

        def work(texts: list[str | None]) -> list[list]:
            n, ids_sha, text_sha = [], [], []
            for t in texts:
                ids = a.encode(t)
                n.append(len(ids))
                ids_sha.append(sha(",".join([a.digits[i] for i in ids])))
                text_sha.append(sha(a.decode(ids)))
            return [n, ids_sha, text_sha]

        return work

    return map_texts(docs, id_col, text_col, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, start)
