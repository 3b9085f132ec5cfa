"""Byte-pair encoding with word ends, and decoding, over whole texts.

A text is cut at the special tokens, normalised (NFC, lower case, white space
dropped) and split into pieces. A piece is merged with a priority queue of
merge ranks over a doubly linked list of symbols: the lowest rank, then the
leftmost place, is merged first; entries whose symbols have since changed are
stale and skipped. Decoding looks up the vocabulary string of every id and
joins them, as a tokenizer without a decoder does.

The tokenizer's file is read once on the driver and broadcast (its size is
fixed and checked). Work runs in Arrow batches, one text after another; pieces
of up to ``CACHED`` characters are kept in a cache that is emptied beyond ``CACHE`` entries.

Defined results: a null text is encoded as the empty text, which has no
tokens. Rows that repeat an id are encoded each. Columns besides the id and the
text are ignored. Ids equal the public library's: where a text holds a letter
or mark that Python's tables and the library's treat differently, the library's
own normalisers are called.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import normalizers

from seriesframe.llm.common import read

CACHE, CACHED = 200_000, 64
MAX_FILE = 64 << 20
#: What separates pieces (Unicode white space as the tokenizer's regular expressions have it).
BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Ranges that the pattern library's newer Unicode tables call letters or
#: numbers and that the tokenizer's tables leave unassigned.
UNASSIGNED = """
558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7
10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6
187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24
1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff
2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""

#: Marks that the tokenizer's tables do not order or compose, a composed vowel and its parts,
#: and capital letters newer than Python's tables.
ODD = """
7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff
10f46-10f50 10f82-10f85 11070 1133b 1145e 11839-1183a 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45
11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136 1e2ae 1e2ec-1e2ef 1e4ec-1e4ef
11930 11935 11938
1c89 a7cb-a7cc a7ce a7d2 a7d4 a7da a7dc 10d50-10d65 16ea0-16eb8
"""

#: A character outside the large ranges that hold none of the above; a quick test before the two exact ones.
BEYOND = re.compile("[^\x00-\u0557\u2000-\u208e\u20a0-\ua7ca\uac00-\ud7ff\ue000-\uffff\U0001f000-\U0001ffff]")


def _class(ranges: str) -> str:
    return "".join("-".join(chr(int(c, 16)) for c in r.split("-")) for r in ranges.split())


class WordBpe(dict):
    """Tokenizer of one file; as a dictionary, the encoded ids (little-endian bytes) of each piece seen."""

    def __init__(self, source: bytes):
        super().__init__()
        spec = json.loads(source)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = dict(map(reversed, (vocab | self.special).items()))
        self.first = [vocab[c] for c in _byte_chars()]
        self.last = [vocab[c + self.end] for c in _byte_chars()]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        split = split.replace(r"\s", BLANK)
        self.pieces = regex.compile(split).findall
        self.rare = regex.compile(f"[{_class(UNASSIGNED)}]").search
        self.odd = regex.compile(f"[{_class(ODD)}]").search
        self.compose, self.lower = normalizers.NFC().normalize_str, normalizers.Lowercase().normalize_str
        for kind in (r"\p{L}", r"\p{N}"):
            split = split.replace(kind, f"[{kind}--[{_class(UNASSIGNED)}]]")
        self.careful_pieces = regex.compile(split, regex.V1).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda t: [t]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.first[b] for b in piece[:-1]] + [self.last[piece[-1]]]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        after[-1] = -1
        find = self.merges.get
        queue = []
        for i in range(n - 1):
            if hit := find((ids[i], ids[i + 1])):
                queue.append((hit[0], i, ids[i], ids[i + 1], hit[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # stale: a neighbour was merged away
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if hit := find((new, ids[k])):
                    heapq.heappush(queue, (hit[0], i, new, ids[k], hit[1]))
            p = before[i]
            if p >= 0 and (hit := find((ids[p], new))):
                heapq.heappush(queue, (hit[0], p, ids[p], new, hit[1]))
        return [x for x in ids if x >= 0]

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= CACHED:
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                find = self.pieces
                if part.isascii():
                    part = part.lower()
                else:
                    seldom = BEYOND.search(part)
                    part = self.lower(self.compose(part)) if seldom and self.odd(part) else unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                    find = self.careful_pieces if seldom and self.rare(part) else find
                out.extend(map(self.__getitem__, find(part)))
        return b"".join(out)

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def _loaded(source: bytes) -> WordBpe:
    return WordBpe(source)


_FIELDS = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}
_TYPES = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}


def encode(docs: DataFrame, tokenizer: str, outputs=("n_tokens", "ids"), text: str = "text", key: str = "doc_id", rows: int = 512) -> DataFrame:
    """The key and the named outputs for each row of ``docs``.

    ``tokenizer`` is the path of the tokenizer's file. Outputs: ``n_tokens``,
    ``ids``, ``decoded`` (the ids decoded again) and the digests ``ids_sha256``
    and ``decoded_sha256``.
    """
    with open(tokenizer, "rb") as f:
        content = f.read(MAX_FILE + 1)
    if len(content) > MAX_FILE:
        raise ValueError(f"the tokenizer's file is larger than {MAX_FILE} bytes")
    source = docs.sparkSession.sparkContext.broadcast(content)
    schema = pa.schema([(o, _FIELDS[o]) for o in outputs])
    decodes = any(o.startswith("decoded") for o in outputs)

    def work(batches):
        bpe = _loaded(source.value)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = {o: [] for o in outputs}
                for t in part.column(1):
                    raw = bpe.encode(t.as_py() or "")
                    ids = np.frombuffer(raw, "<u4")
                    decoded = bpe.decode(ids.tolist()) if decodes else ""
                    values = {"n_tokens": len(ids), "ids_sha256": None, "decoded_sha256": None, "ids": ids.astype(np.int32) if "ids" in out else None, "decoded": decoded}
                    if "ids_sha256" in out:
                        values["ids_sha256"] = hashlib.sha256(raw).hexdigest()
                    if "decoded_sha256" in out:
                        values["decoded_sha256"] = hashlib.sha256(decoded.encode()).hexdigest()
                    for o in outputs:
                        out[o].append(values[o])
                    if len(bpe) > CACHE:
                        bpe.clear()
                made = [pa.array(out[o], schema.field(o).type) for o in outputs]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], names=[batch.schema.names[0], *outputs])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(work, f"`{key}` {kind}, " + ", ".join(f"{o} {_TYPES[o]}" for o in outputs))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), default_tokenizer(), ("n_tokens", "ids_sha256", "decoded_sha256"))
