"""Token ids of whole texts by a public tokenizer file."""

from __future__ import annotations

import hashlib
import json
import math
import os
import re
from collections.abc import Iterator

import numpy as np

from ratemill.llm.memory import remembered

#: Parts remembered by one worker; with so many, new ones are encoded each time they come.
REMEMBERED = 900_000
#: Stands between parts that are encoded together: one id that no other character has.
MARK = "\x01"
#: Characters of texts encoded at once inside a task; a longer text is a slice of its own.
SLICE = 2_000_000
#: Characters that the library gets in one call of an encoder with bounded memory; a longer text is a call of its own.
CALL = 100_000
#: Fixed pattern of the word-end tokenizer: none of its alternatives holds white space.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Any character whose class, lower case or composition may differ between libraries; white space beyond ASCII.
OTHER = re.compile("[^\\t-\\r -~\xa1-įı-ɏ]")


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: another file is another version."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _spaces(spec: dict) -> str | None:
    """How a single space between two other characters acts, where it always ends a token.

    "kept": it begins the next token. "dropped": it is in no token. None: unknown, so
    texts go to the library whole.
    """
    if any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens") or []):
        return None
    before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if norm is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "kept"
    steps = before.get("pretokenizers") or [{}]
    first = steps[0]
    if first.get("pattern") == {"Regex": WORD_SPLIT} and first.get("behavior") == "Removed" and first.get("invert"):
        kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
        return "dropped" if set(kinds) <= {"NFC", "Replace", "Lowercase"} else None
    return None


class Encoder:
    """Ids as the library gives them, as bytes of little-endian unsigned 32-bit integers.

    Where single spaces always end a token, the ids of the parts between them are
    remembered, so that a frequent word is encoded once. Texts with other white
    space beside a space go to the library whole.
    """

    def __init__(self, path: str, most: int | None = None) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.spaces, self.special = _spaces(spec), [t["content"] for t in spec.get("added_tokens") or []]
        self.first: dict[str, bytes | None] = {}
        self.later: dict[str, bytes | None] = {}
        self.marks: dict[str, bytes] = {}
        self.most = most

    def whole(self, texts: list[str]) -> list[bytes]:
        """Where less is remembered, few texts go in one call: what the library returns takes many times the room of the ids."""
        most, out = math.inf if self.most is None else CALL, []
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= most or i + 1 == len(texts):
                part = self.library.encode_batch_fast(texts[start:i + 1], add_special_tokens=False)
                out += [np.array(e.ids, dtype="<u4").tobytes() for e in part]
                start, size = i + 1, 0
        return out

    def _parted(self, parts: list[str], prefix: str) -> list[bytes]:
        """Ids of many parts from few calls, with a mark between them that no part holds."""
        mark = np.frombuffer(self.whole([prefix + MARK])[0], "<u4")
        plain = [p for p in parts if MARK not in p]
        groups = [plain[i:i + 64] for i in range(0, len(plain), 64)]
        own: list[bytes] = []
        for joined in self.whole([prefix + f" {MARK} ".join(g) for g in groups]):
            ends = np.flatnonzero(np.frombuffer(joined, "<u4") == mark[-1])
            starts = [0, *(4 * (ends + 1)).tolist()]
            own += [joined[a:b] for a, b in zip(starts, [*(4 * (ends + 1 - len(mark))).tolist(), len(joined)])]
        known = dict(zip(plain, own))
        return [known[p] if p in known else self.whole([prefix + p])[0] for p in parts]

    def _learn_kept(self, memory: dict[str, bytes | None], parts: set[str], prefix: str) -> None:
        clean = [p for p in parts if p and not p[0].isspace() and not p[-1].isspace()]
        memory.update(dict.fromkeys(parts))
        if memory is self.first:
            memory.update(zip(clean, self.whole(clean)))
        else:
            self._learn_marked(memory, clean, prefix)

    def _learn_marked(self, memory: dict[str, bytes | None], parts: list[str], prefix: str) -> None:
        """A comma or stop behind a letter is a token of its own, so the part before it is learned."""
        marked = [(p, p[:-1], p[-1]) if p[-1] in ",." and p[-2:-1].isalpha() else (p, p, "") for p in parts]
        wanted = list({q for _, q, _ in marked if memory.get(q) is None})
        known = dict(zip(wanted, self._parted(wanted, prefix)))
        if not self.marks:
            self.marks = dict(zip(["", ",", "."], self.whole(["", ",", "."])))
        memory.update([(p, (known[q] if q in known else memory[q]) + self.marks[m]) for p, q, m in marked])

    def _forget(self, memory: dict[str, bytes | None], parts: set[str]) -> None:
        if len(memory) > (REMEMBERED if self.most is None else self.most):
            for part in parts:
                del memory[part]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.spaces is None:
            return self.whole(texts)
        return self._encode_kept(texts) if self.spaces == "kept" else self._encode_dropped(texts)

    def _encode_dropped(self, texts: list[str]) -> list[bytes]:
        """Texts of well-known characters are split in lower case, others at spaces only, as they are."""
        def parts(text: str) -> list[str]:
            low = text.lower()
            return text.split(" ") if OTHER.search(text) or any(s in low for s in self.special) else low.split()

        split, known = [parts(t) for t in texts], self.later
        missing = set().union(*split).difference(known)
        if missing:
            if "" in missing:
                known[""] = b""
            self._learn_marked(known, [p for p in missing if p], "")
        out = [b"".join(map(known.__getitem__, parts)) for parts in split]
        self._forget(known, missing)
        return out

    def _encode_kept(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        first, later = self.first, self.later
        added = [(first, {p[0] for p in split}.difference(first), ""), (later, set().union(*(p[1:] for p in split)).difference(later), " ")]
        for memory, missing, prefix in added:
            if missing:
                self._learn_kept(memory, missing, prefix)
        out: list[bytes] = []
        for text, parts in zip(texts, split):
            head, rest = first[parts[0]], [later[p] for p in parts[1:]]
            if head is None or None in rest:
                out.append(self.whole([text])[0])
            else:
                out.append(head + b"".join(rest))
        for memory, missing, _ in added:
            self._forget(memory, missing)
        return out


def encoder(path: str, most: int | None = None) -> Encoder:
    """One encoder per worker and file that remembers ``most`` parts (None: REMEMBERED), as long as no other operator comes."""
    own = remembered(f"encoder of {path}, {most}")
    if not own:
        own["encoder"] = Encoder(path, most)
    return own["encoder"]


def slices(batches: Iterator, columns: list[str], text: str = "text", most: int = SLICE) -> Iterator[tuple[list[list], list[str]]]:
    """Small groups of rows of Arrow batches: the values of ``columns`` and the texts, null ones empty."""
    for batch in batches:
        column, at = batch.column(text), 0
        while at < batch.num_rows:
            texts: list[str] = []
            size = 0
            for i in range(at, batch.num_rows):
                texts.append(column[i].as_py() or "")
                size += len(texts[-1])
                if size >= most:
                    break
            part = batch.slice(at, len(texts))
            at += len(texts)
            yield [part.column(c).to_pylist() for c in columns], texts
