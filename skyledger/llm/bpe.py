"""BPE encoding and decoding with a tokenisation automaton.

The automaton reads token ids, not characters. It starts as one state that every byte token leads back to; each merge
(u, v) -> uv then puts in a gadget:

* the state that u leads to loses its arc v (u followed by v is now written uv); if other tokens lead there too, u gets a
  copy of its own first;
* wherever an arc u could be taken, an arc uv can be taken too; it leads to where v led.

After all gadgets exactly one path spells any byte string, and it is the string's BPE encoding. The table has a row for each state and a cell for each
token: the next state, or DEAD. Written out, it would have states x tokens cells (14,639 x 50,256 for a common vocabulary), so a cell is worked out
from the gadgets when it is first read, by the token that stands for its row, and is then kept, of so many cells as a worker may hold.

A pre-split word is encoded by one run over its bytes: as there is one path for every beginning of the word, each place has one state,
which the table gives from an earlier place's state and a token between the two (tokens that end at a place are read off a table of their bytes, last byte
first). Nothing is tried again; the path is read off from the end. Decoding emits the arcs' labels, the tokens' bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from skyledger.llm.shared import dealt_out, kept_in_worker, map_batches

#: Words of which a worker keeps the encoding; the store is emptied when it is full (about 100 MB).
CACHED_WORDS = 600_000
#: Fixed value: the pattern that byte-level BPE splits text with.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 30
#: Where an arc is not in a state's row; the state before the first token.
DEAD, START = -1, 0


def byte_letters() -> dict[str, int]:
    """Letter -> byte of the printable alphabet that byte-level vocabularies are written in."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """Token automaton of a merge list; see the module's text. Of the cells, and of the steps by which they are worked out, it holds `cells` at most."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]], cells: int = NEVER):
        self.labels, self.cells = labels, cells
        self.ids = {label: token for token, label in labels.items()}
        made = {m for _, _, m in merges}
        base = [t for t in labels if t not in made]
        #: what is kept per token lies in arrays; a pair of tokens (u, v) is the number u * span + v
        self.span = span = max(labels, default=0) + 1
        self.rank = array("i", [0]) * span
        #: the token whose arcs a merged one copies, and the token whose state it copies
        self.left, self.right = array("i", [-1]) * span, array("i", [-1]) * span
        #: pair -> rank of the gadget that takes the arc away
        self.taken: dict[int, int] = {}
        #: token -> number of the state it leads to, and how many tokens lead to a state; START has a row that no gadget changes
        self.state = array("i", [1]) * span
        sharing, states = {1: len(base)}, 2
        for rank, (left, right, merged) in enumerate(merges, 1):
            # the new arc leads to where `right` led before this gadget
            self.state[merged] = target = self.state[right]
            sharing[target] = sharing.get(target, 0) + 1
            if sharing[self.state[left]] > 1:  # `left` gets a copy of the state, which then loses the arc
                sharing[self.state[left]] -= 1
                self.state[left], sharing[states] = states, 1
                states += 1
            self.rank[merged] = rank
            self.left[merged], self.right[merged] = left, right
            self.taken[left * span + right] = rank
        self.states = states
        #: state -> a token that leads to it, which its row is worked out by
        self.stands = array("i", [-1]) * states
        for token in (*base, *(m for _, _, m in merges)):
            if self.stands[self.state[token]] < 0:
                self.stands[self.state[token]] = token
        self.gone: dict[int, int] = {}
        for rank, (left, right, merged) in enumerate(merges, 1):  # an arc whose parts never met was not put in
            if self._gone(left, right) != rank or self.labels[left] not in self.ids or self.labels[right] not in self.ids:
                self.ids.pop(self.labels[merged], None)
        self.gone.clear()
        #: state * span + token -> next state
        self.table: dict[int, int] = {}
        #: tokens read backward: (node << 8 | byte) -> node, and the token that ends at a node or -1
        self.child: dict[int, int] = {}
        self.token_at = array("i", [-1])
        for label, token in self.ids.items():
            node = 0
            for byte in reversed(label):
                step = node << 8 | byte
                if step not in self.child:
                    self.child[step] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.child[step]
            self.token_at[node] = token

    def _gone(self, before: int, arc: int) -> int:
        """The rank at which `arc` after `before` is taken away; 0: it never was there; NEVER: it stays."""
        cell = before * self.span + arc
        known = self.gone.get(cell)
        if known is not None:
            return known
        rank_before, rank_arc = self.rank[before], self.rank[arc]
        if rank_arc > rank_before:  # the arc was copied from that of its left part, if that was there after the gadget
            alive = self._gone(before, self.left[arc]) > rank_arc
        elif rank_arc == rank_before > 0:  # uv after uv: both parts as they were before the gadget
            alive = self._gone(self.right[arc], self.left[arc]) >= rank_arc
        elif rank_before:  # the state was copied from that of the right part, as it was before the gadget
            alive = self._gone(self.right[before], arc) >= rank_before
        else:
            alive = True
        gone = self.taken.get(cell, NEVER) if alive else 0
        self.gone[cell] = gone
        return gone

    def next_state(self, state: int, token: int) -> int:
        """The table's cell: where the token leads from the state, or DEAD."""
        cell = state * self.span + token
        after = self.table.get(cell)
        if after is None:
            if len(self.table) >= self.cells:
                self.table.clear()
            if len(self.gone) >= self.cells:
                self.gone.clear()
            stays = state == START or self._gone(self.stands[state], token) == NEVER
            after = self.table[cell] = self.state[token] if stays else DEAD
        return after

    def encode(self, word: bytes) -> list[int]:
        """The ids on the one accepted path that spells `word`."""
        child, token_at, span, known = self.child.get, self.token_at, self.span, self.table.get
        states, arcs = [START], [(-1, 0)]  # at each place of the word: the state there, and the token that ends there with where it begins
        for end in range(len(word)):
            node, after = 0, DEAD
            for at in range(end, -1, -1):
                node = child(node << 8 | word[at])
                if node is None:
                    break
                token = token_at[node]
                before = states[at]
                if token >= 0 and before != DEAD:
                    after = known(before * span + token)
                    if after is None:
                        after = self.next_state(before, token)
                    if after != DEAD:
                        break
            states.append(after)
            arcs.append((token, at) if after != DEAD else (-1, end))
        if states[-1] == DEAD:
            raise ValueError("the vocabulary lacks a byte of the word")
        path, at = [], len(word)
        while at:
            token, at = arcs[at]
            path.append(token)
        path.reverse()
        return path

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class ByteBpe:
    """Text to ids and back for a byte-level vocabulary file, as the tokenizers library does it.

    Special tokens in a text become their own ids; no truncation, no padding, nothing added.
    """

    def __init__(self, spec: str, cached: int = CACHED_WORDS):
        self._read(spec, cached)
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        # below U+0250 the standard library's classes can say the same, at twice the speed; superscripts and fractions are numbers there
        self.near_split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_²³¹¼½¾]+| ?[\d²³¹¼½¾]+| ?(?:[^\s\w]+|_)+|\s+(?!\S)|\s+")
        self.not_near = re.compile("[\x1c-\x1fɐ-\U0010ffff]")
        self.far = re.compile("[՘-\U0010ffff]")
        self.spec, self.library = spec, None
        self.words = _Words(self, cached)

    def _read(self, spec: str, cached: int) -> None:
        config = json.loads(spec)
        letters = byte_letters()
        vocab, merges = config["model"]["vocab"], config["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        raw = lambda piece: bytes(map(letters.__getitem__, piece))
        self.automaton = MergeAutomaton({i: raw(p) for p, i in vocab.items()}, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], cached)
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.labels = self.automaton.labels | {i: s.encode() for s, i in self.special.items()}

    def word_ids(self, word: bytes) -> list[int]:
        """The ids of a pre-split word."""
        return self.automaton.encode(word)

    def pieces(self, text: str) -> list[str]:
        """The pre-split words. Characters that Python's tables do not know yet are split by the library's own."""
        if not self.not_near.search(text):
            return self.near_split.findall(text)
        if self.far.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_str(self.spec).pre_tokenizer
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.split.findall(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = self.words
        if self.at_special is None or not self.at_special.search(text):
            return b"".join(map(words.__getitem__, self.pieces(text)))
        out = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += map(words.__getitem__, self.pieces(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


class LibraryBpe(ByteBpe):
    """The same ids, but for words that are not kept the tokenizers library is asked: a quarter of the automaton's time, for operators that encode by the way."""

    def _read(self, spec: str, cached: int) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(spec)
        self.model = library.model
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}

    def word_ids(self, word: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]

    def decode(self, ids: bytes) -> str:
        raise NotImplementedError("it encodes only")


class _Words(dict):
    """word -> ids as bytes, worked out when first read. Of at most `most` words those read last are kept: when half as many are new, the others go."""

    def __init__(self, coder: ByteBpe, most: int):
        self.coder, self.half, self.before = coder, max(1, most // 2), {}

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = array("I", self.coder.word_ids(word.encode("utf-8", "replace"))).tobytes()
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[word] = ids
        return ids


def coder_for(spec: str, cached: int = CACHED_WORDS, kind: type[ByteBpe] = ByteBpe) -> ByteBpe:
    """The worker's coder for a vocabulary file's text, built once for each worker; it keeps the ids of so many words at most."""
    return kept_in_worker(f"{kind.__name__}:{hash(spec)}:{cached}", lambda: kind(spec, cached))


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Every whole text encoded and decoded again, without a shuffle.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids (array<int>) and decoded. `vocabulary` is a
    path that the driver reads; the executors get its text by broadcast (a few MB). Null and empty texts have no ids; long texts are encoded whole.
    Repeated rows, and rows without an id, each give a row. An empty table gives none. Columns of the table besides id and text do not matter.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def rows(batch: pa.RecordBatch) -> dict:
        coder = coder_for(spec.value)
        counts, ids_sha, text_sha, kept, texts = [], [], [], [], []
        for text in batch.column(1):
            ids = coder.encode(text.as_py() or "")
            decoded = coder.decode(ids)
            counts.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            if keep_ids:
                kept.append(memoryview(ids).cast("I").tolist())
                texts.append(decoded)
        out = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
        return out | ({"ids": pa.array(kept, pa.list_(pa.int32())), "decoded": pa.array(texts, pa.string())} if keep_ids else {})

    slim = dealt_out(docs.selectExpr(f"{id_col} AS doc_id", f"{text_col} AS text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_batches(slim, rows, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else ""), keeps=True)
