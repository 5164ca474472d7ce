"""SentencePiece (BPE) encoding and decoding by a merge-type prefix table.

For every prefix of a chunk the table stores the one token with which the
prefix's encoding ends.  Candidates are the vocabulary tokens that an automaton
finds ending there; a candidate of length L holds if the last token of the
prefix L characters shorter and the candidate are compatible, that is, the
merge procedure leaves that pair of tokens as it is.  Reading the table from
the end gives the ids backwards.

What follows a prefix depends on its open tokens only: the ends of the prefix that
begin a longer token, each with the last token before it.  Together they are a
``State`` of the automaton, which remembers the state that each next character
leads to; a row of the table is thus worked out once, not once for each chunk that
needs it.

Chunks: no piece of the model has the space mark after another character or a
line break beside one, so no merge crosses from a character to a following space
mark or over a line break.  The text is cut there and each distinct chunk is
encoded once in a worker.

Cases: null text is empty and gives the end id alone, decoded to the empty
string; characters outside the vocabulary give their UTF-8 bytes as byte ids.
"""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendora.llm.registry import query, table

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
CACHE = 100_000            # distinct chunks kept in a worker before their table is started anew
PAIRS = 200_000            # piece pairs kept in a worker before their table is started anew
STATES = 200_000           # states of the prefix table kept in a worker before they are started anew
PART = 500_000             # characters of ids after which a worker hands on the rows it has
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6     # piece kinds of the model file
NEVER = float("inf")       # what joining two symbols costs that make no piece


class State(dict):
    """Character -> next state, worked out when first asked for."""

    __slots__ = ("model", "opens", "last")

    def __init__(self, model: PieceModel, opens: tuple):
        super().__init__()
        self.model = model
        self.opens = opens          # what is begun of a piece, then the last token before it (-1: none), longest first
        self.last = opens[-1]       # the empty one's: the last token of the prefix

    def __missing__(self, c: str) -> State:
        out = self[c] = self.model.advance(self, c)
        return out


class PieceModel:
    """Pieces of a model file with what encoding and decoding need."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if (spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix):
            raise ValueError("only BPE models with identity normalisation are supported")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.pieces = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses from a character to a space mark")
        if any("\n" in p and p != "\n" for p in self.ids):
            raise ValueError("a piece crosses a line break")
        if any(k not in (NORMAL, UNKNOWN, CONTROL, BYTE) for k in self.kinds):
            raise ValueError("user-defined pieces are not supported")
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.eos = next(i for i, p in enumerate(model.pieces) if p.piece == (spec.eos_piece or "</s>"))
        self.unk_surface = spec.unk_surface
        self.sizes = [len(p) for p in self.pieces]
        self.digits = [str(i) for i in range(len(self.pieces))]
        self.surface = ["" if k == CONTROL else self.unk_surface if k == UNKNOWN else p
                        for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.pair_cache: dict = {}
        self.reachable = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merged(p) == (p,)}
        self.begun = {b: b for p in self.reachable for b in (p[:n] for n in range(1, len(p)))}
        self.letters = {p for p in self.ids if len(p) == 1}
        self.start = State(self, ("", -1))
        self.states: dict = {}

    def merged(self, text: str) -> tuple:
        """The merge procedure itself: join the best-ranked neighbours first,
        the leftmost of equal ones.  Used on pairs of pieces, which are short."""
        sym, rank = list(text), self.rank
        cost = [rank.get(a + b, NEVER) for a, b in pairwise(sym)]       # of joining each symbol to the next
        while cost and (least := min(cost)) < NEVER:
            i = cost.index(least)
            sym[i:i + 2] = [sym[i] + sym[i + 1]]
            del cost[i]
            if i:
                cost[i - 1] = rank.get(sym[i - 1] + sym[i], NEVER)
            if i < len(cost):
                cost[i] = rank.get(sym[i] + sym[i + 1], NEVER)
        return tuple(sym)

    def compatible(self, a: int, b: int) -> bool:
        """Does the merge procedure leave piece a before piece b as they are?"""
        if len(self.pair_cache) >= PAIRS:
            self.pair_cache.clear()
        x, y = self.pieces[a], self.pieces[b]
        hit = self.pair_cache[a << 32 | b] = self.merged(x + y) == (x, y)
        return hit

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of one chunk; characters outside the vocabulary split it, since no merge crosses them."""
        if self.letters.issuperset(chunk):
            return self.encode_known(chunk)
        out: list[int] = []
        start = 0
        for i, c in enumerate(chunk):
            if c not in self.letters:
                out += self.encode_known(chunk[start:i])
                out += [self.bytes[b] for b in c.encode("utf-8", "surrogatepass")]
                start = i + 1
        return out + self.encode_known(chunk[start:])

    def advance(self, state: State, c: str) -> State:
        """The state after one more character.  Of the open pieces that it ends, one holds."""
        opens: list = []
        last, pairs, it = -1, self.pair_cache, iter(state.opens)
        for before, p in zip(it, it, strict=True):
            piece = before + c
            if last < 0 and (k := self.reachable.get(piece)) is not None:
                ok = p < 0 or pairs.get(p << 32 | k)
                if ok is None:
                    ok = self.compatible(p, k)
                if ok:
                    last = k
            if (b := self.begun.get(piece)) is not None:
                opens += (b, p)
        key = (*opens, "", last)
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= STATES:
                self.start.clear()
                for x in self.states.values():
                    x.clear()
                self.states.clear()
            found = self.states[key] = State(self, key)
        return found

    def encode_known(self, chunk: str) -> list[int]:
        """Ids of characters that are all in the vocabulary, from the prefix table."""
        state = self.start
        path = [state := state[c] for c in chunk]
        out: list[int] = []
        i = len(chunk)
        while i > 0:
            k = path[i - 1].last
            out.append(k)
            i -= self.sizes[k]
        out.reverse()
        return out

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return CHUNK.findall(self.prefix + text.replace(" ", MARK))

    def encode(self, text: str) -> list[int]:
        """Ids of a text, the end id last."""
        return [k for c in self.chunks(text) for k in self.encode_chunk(c)] + [self.eos]

    def pieces_text(self, ids: list[int], first: bool) -> str:
        """Text of ids; ``first`` drops the space that encoding put before the text."""
        surface = self.surface
        if self.byte_of.keys().isdisjoint(ids):
            s = "".join([surface[k] for k in ids])
        else:
            out, run = [], bytearray()
            for k in ids:
                if k in self.byte_of:
                    run.append(self.byte_of[k])
                    continue
                if run:
                    out.append(decode_bytes(bytes(run)))
                    run.clear()
                out.append(surface[k])
            if run:
                out.append(decode_bytes(bytes(run)))
            s = "".join(out)
        if first and self.prefix and s.startswith(MARK):
            s = s[1:]
        return s.replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        return self.pieces_text(ids, True)


def decode_bytes(run: bytes) -> str:
    """Byte pieces as text: each byte that starts no valid character gives one U+FFFD."""
    out, i = [], 0
    while i < len(run):
        for size in range(1, 5):
            try:
                out.append(run[i:i + size].decode("utf-8"))
                i += size
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            i += 1
    return "".join(out)


_MODELS: dict = {}


def model_of(path: str) -> PieceModel:
    """One model in each Python worker."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable(dict):
    """Chunk -> (its ids as text, the text that these ids decode to)."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model

    def __missing__(self, chunk: str) -> tuple[str, str]:
        if len(self) >= CACHE:
            self.clear()
        ids, digits = self.model.encode_chunk(chunk), self.model.digits
        out = self[chunk] = (" ".join([digits[k] for k in ids]), self.model.pieces_text(ids, False))
        return out


_TABLES: dict = {}


def table_of(path: str) -> ChunkTable:
    """One table in each Python worker."""
    if path not in _TABLES:
        _TABLES[path] = ChunkTable(model_of(path))
    return _TABLES[path]


def encode_text(known: ChunkTable, text: str) -> tuple[str, str]:
    """(decimal ids joined by one space, decoded text)."""
    model = known.model
    both = [known[c] for c in model.chunks(text)]
    ids = " ".join([*[x[0] for x in both], str(model.eos)])
    back = "".join([x[1] for x in both])
    # the mark that encoding put before the text is the first character of the first chunk
    return ids, back[1:] if model.prefix and back.startswith(" ") else back


def encoder(path: str | None = None, with_text: bool = True):
    """Arrow batches with a text column in, the other columns with n_tokens,
    ids_sha256 and decoded, ids (or decoded_sha256) out.  A batch leaves in parts, so
    that a worker never holds the ids of all of its texts."""

    def out(part, rows):
        cols = {f.name: part.column(k) for k, f in enumerate(part.schema) if f.name != "text"}
        cols["n_tokens"] = pa.array([ids.count(" ") + 1 for ids, _ in rows], pa.int64())
        cols["ids_sha256"] = pa.array([hashlib.sha256(ids.encode()).hexdigest() for ids, _ in rows], pa.string())
        if with_text:
            cols["decoded"] = pa.array([back for _, back in rows], pa.string())
            each = [np.array(ids.split(" "), np.int32) for ids, _ in rows]
            ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
            cols["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(each)))
        else:
            cols["decoded_sha256"] = pa.array([hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest() for _, back in rows], pa.string())
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    def run(batches):
        known = table_of(path or default_path())
        for batch in batches:
            rows, start, size = [], 0, 0
            for i, text in enumerate(batch.column(batch.schema.get_field_index("text")), 1):
                rows.append(encode_text(known, text.as_py() or ""))
                size += len(rows[-1][0])
                if size >= PART or i == batch.num_rows:
                    yield out(batch.slice(start, i - start), rows)
                    rows, start, size = [], i, 0
    return run


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                     path: str | None = None, with_text: bool = True) -> DataFrame:
    """Encode and decode each text.  With ``with_text``: the ids and the decoded
    text; without: their digests only.  One row per input
    row, repeats included; other columns are left out, so none can clash."""
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    tail = "decoded string, ids array<int>" if with_text else "decoded_sha256 string"
    out = src.mapInArrow(encoder(path, with_text), f"key {kind}, n_tokens long, ids_sha256 string, {tail}")
    return out.withColumnRenamed("key", key)


@query("op7_sentencepiece")
def op7(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), with_text=False)
