"""BPE encoding and decoding with the vocabularies of the tokenizers library.

A short word is held as a contiguous array of parts and an array of the ranks of adjacent pairs:
the smallest rank is found by a scan, its boundary deleted, and the two neighbouring ranks
refreshed.  Words of more parts than LONG_WORD take a heap instead, so that a text without white
space stays within n log n.

Defined results: a null text counts as empty and has no ids.  Repeated rows are encoded alike, and
an empty table gives an empty table.  Extra input columns are left out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.shared import workers, strip_to

#: Parts above which a word is merged with a heap.
LONG_WORD = 200
#: Words whose ids a worker remembers; then it forgets all and starts anew.
MEMO_WORDS = 300_000
#: Longer words aren't remembered.
MEMO_CHARS = 64
NONE = 1 << 30


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


# The code points that the regex module takes for letters or numbers and the
# tokenizers library, whose Unicode tables differ, does not.
UNASSIGNED = """
558 58b-58c 88f c5c cdc 1c89 208f 209d-209f a7cb-a7cc a7ce-a7cf a7d2 a7d4 a7da a7dc-a7dd a7e2 a7f1 ab6c-ab6d
107bb-107bf 10940-10959 10d50-10d65 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f
12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2
18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de
1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479
3d000-3fc3f
"""


def _unassigned() -> str:
    """UNASSIGNED as a character class."""
    return "[" + "".join("-".join(f"\\U{int(x, 16):08x}" for x in part.split("-")) for part in UNASSIGNED.split()) + "]"


class _Memo(dict):
    """Word to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(word), dtype="<u4").tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Bpe:
    """A byte-level BPE model with words and an end-of-word suffix, from a tokenizer's JSON."""

    def __init__(self, config: str):
        spec = json.loads(config)
        model, normalizer, split = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        kinds = [n["type"] for n in normalizer["normalizers"]]
        steps = split["pretokenizers"]
        known = (
            model["type"] == "BPE" and kinds == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
            and spec["post_processor"] is None and spec["decoder"] is None and not model["continuing_subword_prefix"]
        )
        if not known:
            raise ValueError("this tokenizer has steps that aren't supported")
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        # The white space that the Replace step folds is dropped by the split in any case.
        pattern = steps[0]["pattern"]["Regex"]
        self.words = regex.compile(pattern, regex.V0).findall
        self.unassigned = regex.compile(_unassigned(), regex.V1).search
        strict = pattern.replace(r"[\p{L}]", rf"[\p{{L}}--{_unassigned()}]").replace(r"[\p{N}]", rf"[\p{{N}}--{_unassigned()}]")
        strict = strict.replace(r"[^\s\p{L}\p{N}]", rf"[^\s[[\p{{L}}\p{{N}}]--{_unassigned()}]]")
        self.strict_words = regex.compile(strict, regex.V1).findall
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.final = [vocab.get(s + self.suffix) for s in symbols]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((vocab[left], vocab[right]), r)
            self.made.append(vocab[left + right])
        self.memo = _Memo(self.encode_word)

    def encode_word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        parts = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        parts = [p for p in parts if p is not None]
        return self._heap(parts) if len(parts) > LONG_WORD else self._scan(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        get, made = self.rank.get, self.made
        ranks = [get(p, NONE) for p in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            parts[i] = made[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NONE)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        pieces = self.specials.split(text) if self.specials else [text]
        out = []
        for piece in pieces:
            if piece in self.added:
                out.append(self.added[piece].to_bytes(4, "little"))
            elif piece:
                # Letter by letter, a capital sigma has one lower case only.
                plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                words = self.words if plain.isascii() or not self.unassigned(plain) else self.strict_words
                out.extend(map(self.memo.__getitem__, words(plain)))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids joined with spaces, as a tokenizer without a decoder does."""
        return " ".join(map(self.tokens.__getitem__, ids))


_MODELS: dict[str, Bpe] = {}


def _model(config: str) -> Bpe:
    key = hashlib.md5(config.encode()).hexdigest()
    if key not in _MODELS:
        _MODELS[key] = Bpe(config)
    return _MODELS[key]


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """(id, outputs) of every row, in the order asked for.

    vocabulary: path on the driver of a tokenizer's JSON; its content (a few MB) goes to the
    executors.  outputs: ids, decoded, n_tokens, ids_sha256, decoded_sha256.
    """
    spark = docs.sparkSession
    workers(spark)
    with open(vocabulary, encoding="utf-8") as f:
        config = spark.sparkContext.broadcast(f.read())
    kinds = {"ids": ("array<bigint>", pa.list_(pa.int64())), "decoded": ("string", pa.string()), "n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    rows = strip_to(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(config.value)
        for b in batches:
            made = {o: [] for o in outputs}
            for t in b.column(1):
                raw = model.encode_bytes(t.as_py())
                ids = np.frombuffer(raw, dtype="<u4").tolist()
                text = model.decode(ids) if "decoded" in made or "decoded_sha256" in made else ""
                for o, values in made.items():
                    if o == "ids":
                        values.append(ids)
                    elif o == "decoded":
                        values.append(text)
                    elif o == "n_tokens":
                        values.append(len(ids))
                    elif o == "ids_sha256":
                        values.append(hashlib.sha256(raw).hexdigest())
                    else:
                        values.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(made[o], kinds[o][1]) for o in outputs]], names=["id", *outputs])

    schema = ", ".join([f"id {rows.schema['id'].dataType.simpleString()}", *[f"{o} {kinds[o][0]}" for o in outputs]])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
