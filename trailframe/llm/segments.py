"""Token ids of texts through per-worker caches of space-cut segments.

For byte-level BPE with the usual pre-token pattern, a space starts a new
pre-token unless white space stands on both of its sides (or before it at
the end of the text).  A text without such a space, and without the string
of an added token, therefore encodes to the concatenation of its space-cut
segments, each with its leading space.  Segments repeat, so their encodings
are looked up; unseen ones are encoded by the library in one batch.  Any
other text is encoded whole by the library, so results are the library's
in every case.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: a space with white space on both sides or between white space and the end
UNSAFE = re.compile(r"\s (?:\s|\Z)")
#: entries of one generation of a worker's cache (it holds two)
MAX_ENTRIES = 125_000

_WORKERS: dict[str, SegmentEncoder | IdEncoder] = {}


def cacheable(spec: dict) -> bool:
    """Whether the pipeline of a tokenizer file is the one described above."""
    pre = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True) and not pre.get("add_prefix_space")
            and spec["model"].get("type", "BPE") == "BPE"
            and not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec.get("added_tokens", [])))


class Generations:
    """A cache of bounded size: entries that are used again move on to the
    young generation, the others go with the old one."""

    def __init__(self, size: int, table: dict | None = None):
        self.size = size
        self.table = table or {}
        self.young: dict = {}
        self.old: dict = {}

    def look_up(self, keys: list, make) -> list:
        """Values of all keys; ``make`` gives those of a list of new keys."""
        values = list(map(self.young.get, keys))
        if None not in values:
            return values
        lost = [i for i, v in enumerate(values) if v is None]
        got: dict = {}
        new = []
        for k in dict.fromkeys([keys[i] for i in lost]):
            v = self.table.get(k)
            if v is None:
                v = self.old.get(k)
            if v is None:
                new.append(k)
            else:
                got[k] = v
        for a in range(0, len(new), 4096):
            part = new[a:a + 4096]
            got.update(zip(part, make(part)))
        for i in lost:
            values[i] = got[keys[i]]
        if len(self.young) + len(got) > self.size:
            self.old, self.young = self.young, {}
        if len(got) <= self.size:
            self.young.update(got)
        return values


class SegmentEncoder:
    """``encode(texts)`` gives, for each text, the value of its ids: their
    little-endian 32-bit bytes, or their number (``count=True``)."""

    def __init__(self, spec_json: str, count: bool = False, frequent: dict[str, int] | None = None,
                 max_entries: int = MAX_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each Spark task
        from tokenizers import Tokenizer

        spec = json.loads(spec_json)
        self.tok = Tokenizer.from_str(spec_json)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = cacheable(spec)
        self.count = count
        self.later = Generations(max_entries, frequent)
        self.first = Generations(max_entries // 8)

    def library(self, texts: list[str]) -> list:
        out = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        if self.count:
            return [len(e.ids) for e in out]
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in out]

    def whole(self, t: str) -> bool:
        return not self.cut or UNSAFE.search(t) is not None or any(a in t for a in self.added)

    def encode(self, texts: list[str | None]) -> list:
        out: list = [None] * len(texts)
        firsts, pieces, at, which, full = [], [], [0], [], []
        for i, t in enumerate(texts):
            if not t:
                out[i] = 0 if self.count else b""
            elif self.whole(t):
                full.append(i)
            else:
                cut = t.split(" ")
                firsts.append(cut[0])
                pieces += cut[1:]
                at.append(len(pieces))
                which.append(i)
        if full:
            for i, v in zip(full, self.library([texts[i] for i in full])):
                out[i] = v
        if which:
            head = self.first.look_up(firsts, self.library)
            tail = self.later.look_up(pieces, lambda new: self.library([" " + p for p in new]))
            for k, i in enumerate(which):
                part = tail[at[k]:at[k + 1]]
                out[i] = head[k] + sum(part) if self.count else head[k] + b"".join(part)
        return out


#: the pre-token pattern of byte-level tokenizer files, a fixed value
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: a run of white space that is left to the library
LONG_GAP = re.compile(r"\s{1000}")


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """Bytes and ids of a byte-level vocabulary whose ids follow the order of
    its merges, or None.  For such a vocabulary, in which every token's bytes
    encode to that token, merging by least id is merging by first rule: while
    parts make up a token's bytes and no earlier merge is open, they are what
    the token's bytes alone would be at that point."""
    model = spec["model"]
    if (not cacheable(spec) or model.get("dropout") or model.get("continuing_subword_prefix")
            or model.get("end_of_word_suffix") or model.get("ignore_merges") or model.get("byte_fallback")):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if (any(c not in byte_of for t in vocab for c in t) or any(c not in vocab for c in byte_of)
            or len(vocab) != 256 + len(merges)):
        return None
    ids = [vocab.get(a + b, -1) for a, b in merges]
    if ids != sorted(ids) or len(set(ids)) != len(ids) or max((vocab[c] for c in byte_of)) > min(ids, default=1 << 30):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}


class IdEncoder:
    """``encode(texts)``: the little-endian 32-bit ids of each text.  A
    byte-level vocabulary that :func:`byte_ranks` takes runs on tiktoken's
    merge loop, several times as fast as the file's own library; texts with
    an added token's string or a very long gap, and all other vocabularies,
    run on the library.  The ids are the library's in every case."""

    def __init__(self, spec_json: str):
        self.slow = SegmentEncoder(spec_json)
        ranks = byte_ranks(json.loads(spec_json))
        self.fast = None
        if ranks is not None:
            import tiktoken

            fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
            if all(fast.encode_single_token(t) == i for t, i in ranks.items()) and self._reachable(ranks, fast):
                self.fast = fast

    @staticmethod
    def _reachable(ranks: dict[bytes, int], fast) -> bool:
        """Whether every token's bytes encode to that token."""
        return all(fast._encode_single_piece(t) == [i] for t, i in ranks.items())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.fast is None:
            return self.slow.encode(texts)
        out: list[bytes] = []
        for t in texts:
            if not t:
                out.append(b"")
            elif any(a in t for a in self.slow.added) or LONG_GAP.search(t):
                out += self.slow.encode([t])
            else:
                out.append(np.array(self.fast.encode_ordinary(t), dtype="<u4").tobytes())
        return out


def worker_ids(key: str, spec_json: str) -> IdEncoder:
    """The id encoder of this Python worker (kept between its tasks)."""
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = IdEncoder(spec_json)
    return _WORKERS[key]


def worker_encoder(key: str, spec_json: str, count: bool = False,
                   frequent: dict[str, int] | None = None) -> SegmentEncoder:
    """The encoder of this Python worker (kept between its tasks)."""
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = SegmentEncoder(spec_json, count, frequent)
    return _WORKERS[key]


def slices(texts: list, limit: int = 1 << 20):
    """``(first, part)`` slices of about ``limit`` characters."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > limit:
            yield first, texts[first:i]
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, texts[first:]


def read_tokenizer(path: str | None, name: str) -> str:
    """The tokenizer file as text; by default the public one called ``name``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        return f.read()
