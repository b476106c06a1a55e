"""Byte-level BPE and SentencePiece over batches, through tables of distinct chunks."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pagemill.llm.chunk_table import ChunkTable
from pagemill.llm.common import IS_SPACE, cached, slices, text_arrays

#: Bytes of joined chunks that the BPE library gets as one text.
JOIN_BYTES = 1 << 16

IS_SPACE_BYTE = IS_SPACE.tolist()
_SAFE_ASCII = np.zeros(256, bool)
_SAFE_ASCII[0x21:0x7F] = True


def _safe_end(buf: np.ndarray) -> np.ndarray:
    """Whether a character that is certainly no white space ends at each byte: printable ASCII, or
    a two-byte character from U+00C0 on. Others count as unsafe, which only makes chunks longer."""
    safe = _SAFE_ASCII[buf]
    safe[1:] |= (buf[1:] >= 0x80) & (buf[:-1] >= 0xC3) & (buf[:-1] <= 0xDF)
    return safe


def _bpe_cuts(buf: np.ndarray) -> np.ndarray:
    """The pattern's pieces never reach from a non-space over a space, and look ahead only inside
    white space: a safe cut is where white space follows a character that is none."""
    out = np.zeros(len(buf), bool)
    out[1:] = IS_SPACE[buf[1:]] & _safe_end(buf)[:-1]
    return out


@cached
def bpe(path: str) -> ChunkTable:
    """The table of a byte-level BPE file of the tokenizers library, as it is: special tokens' strings
    in a text give their ids. Whole texts are its chunks if such a string may reach over a cut. One
    for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    apart = all(not (a.lstrip or a.rstrip or a.single_word or any(c.isspace() for c in a.content)) for a in t.get_added_tokens_decoder().values())
    width = np.zeros(t.get_vocab_size() + 1, np.int64)
    for token, i in t.get_vocab().items():
        width[i] = len(token)

    def alone(texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in t.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]

    def segment(chunks: list[bytes], opening: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that begin with white space and end safely are joined, and the ids dealt out
        again by the bytes that they stand for; the rest is encoded one by one."""
        lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
        joined = np.fromiter((IS_SPACE_BYTE[c[0]] and 0x21 <= c[-1] < 0x7F for c in chunks), bool, len(chunks))
        out, n, order = [], np.zeros(len(chunks), np.int64), []

        def one_by_one(own: list[int]) -> None:
            found = alone([chunks[i] for i in own])
            n[own] = [len(x) for x in found]
            out.extend(found)
            order.append(own)

        if not joined.all():
            one_by_one(np.flatnonzero(~joined).tolist())
        those = np.flatnonzero(joined)
        group = np.cumsum(lens[those]) // JOIN_BYTES
        for own in np.split(those, np.flatnonzero(np.diff(group)) + 1):
            if not len(own):
                continue
            ids = alone([b"".join([chunks[i] for i in own.tolist()])])[0]
            upto, want = np.cumsum(width[ids]), np.cumsum(lens[own])
            at = np.searchsorted(upto, want)
            if upto[-1] != want[-1] or (upto[at] != want).any():
                one_by_one(own.tolist())
                continue
            n[own] = np.diff(at, prepend=-1)
            out.append(ids)
            order.append(own)
        return _in_order(out, n, np.concatenate(order))

    return ChunkTable(_bpe_cuts if apart else _never, segment)


def _in_order(out: list[np.ndarray], n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that lie chunk by chunk in another order, in the order of the chunks; n: ids of each."""
    ids = np.concatenate([np.zeros(0, np.uint32), *out])
    at = np.empty(len(n), np.int64)
    at[order] = np.cumsum(n[order]) - n[order]
    return ids[np.arange(len(ids)) + np.repeat(at - (np.cumsum(n) - n), n)], n


def _piece_cuts(buf: np.ndarray) -> np.ndarray:
    """A space after a byte that is neither a space nor the end of a literal marker (U+2581)."""
    out = np.zeros(len(buf), bool)
    marker = buf == 0x20
    marker[2:] |= (buf[2:] == 0x81) & (buf[1:-1] == 0x96) & (buf[:-2] == 0xE2)
    out[1:] = (buf[1:] == 0x20) & ~marker[:-1]
    return out


def _never(buf: np.ndarray) -> np.ndarray:
    return np.zeros(len(buf), bool)


@cached
def piece_processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def pieces_stay_apart(path: str) -> bool:
    """Whether no piece of the model holds a marker after another character, and its normaliser
    changes nothing but the marker: then each marked word can be segmented by itself."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    n = m.normalizer_spec
    plain = n.name == "identity" and not n.precompiled_charsmap and not n.normalization_rule_tsv and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
    usual = m.trainer_spec.model_type == 2 and not m.trainer_spec.treat_whitespace_as_suffix
    return plain and usual and not any("▁" in p.piece.lstrip("▁") or p.type == 4 for p in m.pieces)


@cached
def pieces(path: str) -> ChunkTable:
    """The table of a SentencePiece model; whole texts are its chunks if pieces may cross markers."""
    sp = piece_processor(path)

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in sp.encode(texts, num_threads=1)] if texts else []

    def flat(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.fromiter(map(len, found), np.int64, len(found))

    if not pieces_stay_apart(path):
        return ChunkTable(_never, lambda chunks, opening: flat(encode([c.decode() for c in chunks])))
    lead = len(sp.encode("a"))

    def segment(chunks: list[bytes], opening: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The dummy prefix of a chunk encoded alone stands for its own first space; one of spaces
        only follows a letter, whose ids are cut off again."""
        texts = [c.decode() for c in chunks]
        blank = [not o and not t.strip(" ▁") for t, o in zip(texts, opening.tolist())]
        ids = encode([t if o else "a" + t if b else t[1:] for t, o, b in zip(texts, opening.tolist(), blank)])
        return flat([x[lead:] if b else x for x, b in zip(ids, blank)])

    return ChunkTable(_piece_cuts, segment)


def token_slices(batches: Iterator[pa.RecordBatch], tables) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each slice of rows with the ids of its texts and their offsets."""
    for part in slices(batches, keep_caches=True):
        buf, offsets = text_arrays(part.column("text"))
        yield part, *tables.encode(buf, offsets)


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)


def sha256(ids: np.ndarray) -> str:
    return hashlib.sha256(np.ascontiguousarray(ids, "<u4").data).hexdigest()
