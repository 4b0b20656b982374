"""Token ids of whole texts with a public tokenizer file.

White space always separates tokens of the word tokenizer used here, so a text's
ids are the ids of its blank-separated chunks one after the other. Chunks repeat,
and looking them up is far cheaper than encoding them again.
"""

from __future__ import annotations

import gc
import os

import numpy as np

from .common import worker_store

CHUNKS_KEPT = 500_000  # per generation; older chunks are encoded again when they return
CHUNKS_AT_ONCE = 2_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, kept: int = CHUNKS_KEPT):
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.stops = {s: self.ids(s) for s in ".,"}

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, chunks: list[str]) -> None:
        for i in range(0, len(chunks), CHUNKS_AT_ONCE):
            part = chunks[i : i + CHUNKS_AT_ONCE]
            coded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.fromiter((o[0] for o in coded.offsets), np.int64, len(coded.ids))
            lengths = np.fromiter(map(len, part), np.int64, len(part)) + 1
            cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
            ids = np.array(coded.ids, dtype="<u4").tobytes()
            cuts = (cuts * 4).tolist()
            for chunk, a, b in zip(part, cuts, cuts[1:]):
                self.young[chunk] = ids[a:b]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the chunks not yet known are encoded together."""
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}
        get = self.young.get
        found, missing = [], set()
        for text in texts:
            if "<|" in text:  # special tokens are matched before anything else
                found.append(self.ids(text))
                continue
            # the tokenizer lowers all letters; lowering A-Z first makes chunks meet
            chunks = text.encode().lower().decode().replace("\n", " ").split(" ")
            parts = [*map(get, chunks)]
            if None in parts:
                missing.update([c for c, p in zip(chunks, parts) if p is None])
                found.append((chunks, parts))
            else:
                found.append(b"".join(parts))
        if missing:
            self.fetch(missing)
        known = self.young
        return [
            f if isinstance(f, bytes) else b"".join([known[c] if p is None else p for c, p in zip(*f)]) for f in found
        ]

    def fetch(self, missing: set[str]) -> None:
        """Bring chunks into the young generation."""
        # a letter and a stop never share a token: "word," is "word" and ","
        ended = {c for c in missing if len(c) > 1 and c[-1] in self.stops and "a" <= c[-2] <= "z"}
        wanted = (missing - ended) | {c[:-1] for c in ended}
        unknown = []
        for chunk in wanted.difference(self.young):
            known = self.old.get(chunk)
            if known is None:
                unknown.append(chunk)
            else:
                self.young[chunk] = known
        self.learn(unknown)
        for chunk in ended:
            self.young[chunk] = self.young[chunk[:-1]] + self.stops[chunk[-1]]


def encoder(path: str, kept: int = CHUNKS_KEPT) -> ChunkEncoder:
    """The worker's encoder, kept between tasks."""
    # the cached chunks hold no cycles; looking through them for some costs a quarter of the time
    gc.set_threshold(200_000, 50, 1000)
    store = worker_store()
    key = ("chunk_encoder", path, kept)
    if key not in store:
        store[key] = ChunkEncoder(path, kept)
    return store[key]


def encoded(path: str, texts, at_once: int = 64, kept: int = CHUNKS_KEPT):
    """The ids of an Arrow column of texts, null as empty, a few texts at a time."""
    code = encoder(path, kept).encode
    for start in range(0, len(texts), at_once):
        yield from code([t or "" for t in texts.slice(start, at_once).to_pylist()])
