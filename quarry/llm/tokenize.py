"""Tokenising whole texts with a cache of the pieces that the tokenizer cannot join.

Both vocabularies split a text before they merge, and never across the place where blank text follows other text. A text is
therefore the concatenation of its pieces, and pieces repeat: each Python worker keeps those it has met (up to a bound).
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Characters that str.split() takes for blanks and the tokenizers' patterns do not.
ODD_BLANKS = "\x1c\x1d\x1e\x1f"
_LOADED: dict[tuple, object] = {}


def load(path: str, plain_specials: bool = False):
    """The tokenizer in a file of the tokenizers library, one for each worker; special tokens may be plain text in it."""
    key = path, plain_specials
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.encode_special_tokens = plain_specials
        _LOADED[key] = tokenizer
    return _LOADED[key]


def kept(kind: type, *arguments):
    """An encoder of this kind that a worker keeps from one task to the next, with the pieces that it has met."""
    key = (kind, *arguments)
    if key not in _LOADED:
        _LOADED[key] = kind(*arguments)
    return _LOADED[key]


def splits_at_blanks(tokenizer) -> bool:
    """Whether a vocabulary is byte-level, rewrites nothing, and begins the parts that it merges at blanks."""
    made = json.loads(tokenizer.to_str())
    split = made["pre_tokenizer"] or {}
    blanks_inside = any(c in t["content"] for t in made["added_tokens"] for c in " \n")
    return made["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"] and not blanks_inside


#: What stands before the merges of the vocabulary with word ends: fixed values of its kind of file.
WORD_END_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def has_word_ends(spec: dict) -> bool:
    """Whether a tokenizer file (as JSON) is of the kind with word ends: lower case, blanks dropped, one known split pattern."""
    normalizer, split = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    parts = split.get("pretokenizers") or [{}]
    first, rest = parts[0], parts[1:]
    return (
        normalizer.get("normalizers") == WORD_END_NORMALIZERS and first.get("pattern") == {"Regex": WORD_END_PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True
        and [(p["type"], p["add_prefix_space"], p["use_regex"]) for p in rest] == [("ByteLevel", False, False)] and bool(spec["model"].get("end_of_word_suffix"))
    )


def vocabulary_path(name: str) -> str:
    """A file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def blank_pieces(text: str) -> list[str]:
    """Pieces between blanks, for vocabularies that drop blanks; the whole text where the two notions of blanks differ."""
    if any(c in text for c in ODD_BLANKS):
        return [text]
    return text.split()


#: Marks that the pattern splits from letters and digits before them.
TAILS = ".,;:!?"


def letters_only(tokenizer):
    """The same merges for lower-case words of letters with single blanks between: nothing is rewritten, and blanks alone split."""
    from tokenizers import Tokenizer

    made = json.loads(tokenizer.to_str())
    made |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *made["pre_tokenizer"]["pretokenizers"][1:]]}}
    return Tokenizer.from_str(json.dumps(made))


class IdEncoder:
    """Token ids of whole texts as bytes; by pieces for a vocabulary with word ends (see `has_word_ends`), else whole.

    The new pieces of some texts are encoded by the library as one text, with a blank between two, and its offsets tell which
    ids are whose. Pieces are kept from one call to the next in two generations; that changes no result.
    """

    KEPT, TOGETHER = 600_000, 4000

    def __init__(self, path: str, dtype: str):
        self.tokenizer, self.dtype = load(path), np.dtype(dtype)
        self.by_piece = has_word_ends(json.loads(self.tokenizer.to_str()))
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.heads = {a[0] for a in self.added}
        if self.by_piece:
            self.letters, end = letters_only(self.tokenizer), json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
            self.last = np.zeros(max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1, bool)
            self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(end)]] = True
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, text: str):
        found = self.tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, self.dtype), found

    def _parts(self, piece: str) -> tuple[str, str]:
        """A piece as what has the same ids: its lower-case core, and marks after a letter or digit; the piece alone where that is not certain.

        A piece that holds an added token in any case stays as it is, for added tokens are matched before letters are lowered.
        """
        if piece.isalpha() and piece.islower():
            return piece, ""
        core = piece.rstrip(TAILS)
        if not core or not (core.isascii() or core.isalpha() and max(core) < "\u0250"):
            return piece, ""
        low = core.lower()
        if len(low) != len(core) or not self.heads.isdisjoint(low) and any(a in piece.lower() for a in self.added):
            return piece, ""
        return (low, piece[len(core) :]) if core[-1].isalnum() else (low + piece[len(core) :], "")

    def _encode(self, pieces: list[str]) -> None:
        """Encode pieces together: words of letters in the form they are looked up by without rewriting and patterns, others with the library's offsets."""
        words, others = [], []
        for p in pieces:
            (words if p.isalpha() and p.islower() and max(p) < "\u0250" else others).append(p)
        for i in range(0, len(words), self.TOGETHER):
            part = words[i : i + self.TOGETHER]
            ids = np.array(self.letters.encode(" ".join(part), add_special_tokens=False).ids, self.dtype)
            self._keep(part, ids, np.flatnonzero(self.last[ids]) + 1)
        for i in range(0, len(others), self.TOGETHER):
            part = others[i : i + self.TOGETHER]
            ids, found = self._ids(" ".join(part))
            begins = np.cumsum(np.array([0, *map(len, part[:-1])]) + (np.arange(len(part)) > 0))
            owner = np.searchsorted(begins, np.array([a for a, _ in found.offsets], np.int64), side="right") - 1
            self._keep(part, ids, np.cumsum(np.bincount(owner, minlength=len(part))))

    def _keep(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        cuts, data = (ends * self.dtype.itemsize).tolist(), ids.tobytes()
        self.young.update(zip(pieces, [data[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))

    def _learn(self, pieces: list[str]) -> None:
        parts = list(map(self._parts, pieces))
        words = {core for core, _ in parts}.union([tail for _, tail in parts if tail]).difference(self.young)
        kept = words.intersection(self.old)
        self.young.update(zip(kept, map(self.old.__getitem__, kept), strict=True))
        self._encode(list(words - kept))
        ids = self.young
        ids.update(zip(pieces, [ids[core] + ids[tail] if tail else ids[core] for core, tail in parts], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return [self._ids(t)[0].tobytes() for t in texts]
        if len(self.young) > self.KEPT:
            self.old, self.young = self.young, {}
        pieces = [None if any(c in t for c in ODD_BLANKS) else t.split() for t in texts]
        new = set().union(*filter(None, pieces)).difference(self.young)
        kept = new.intersection(self.old)
        self.young.update(zip(kept, map(self.old.__getitem__, kept), strict=True))
        self._learn(list(new - kept))
        value = self.young.__getitem__
        return [self._ids(t)[0].tobytes() if p is None else b"".join(map(value, p)) for t, p in zip(texts, pieces, strict=True)]


#: A unit: blanks, and all up to the next blank.
UNIT = re.compile(r"[ \n]*[^ \n]+")


def units(text: str) -> list[str] | None:
    """A text cut before each run of spaces and line feeds; None if it is empty or ends in one."""
    if not text or text[-1] in " \n":
        return None
    if "\0" in text or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return UNIT.findall(text)
    parts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return parts if parts[0] else parts[1:]


class Growing:
    """An array that is appended to."""

    def __init__(self, dtype=np.int64):
        self.data, self.n = np.zeros(1024, dtype), 0

    def append(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate((self.data, np.zeros_like(self.data)))
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    def __getitem__(self, at):
        return self.data[: self.n][at]


def spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begins[k], begins[k] + 1, ... for each k, counts[k] of them."""
    return np.arange(int(counts.sum())) + np.repeat(begins - (np.cumsum(counts) - counts), counts)


class SpanEncoder:
    """Character spans of all tokens of whole texts.

    With a byte-level vocabulary that rewrites nothing, units are encoded once, many together, and kept (up to a bound); a text
    with a unit that blanks of another kind might join to the next one, and every text of another vocabulary, is encoded whole.
    """

    KEPT, TOGETHER = 400_000, 4000

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.by_unit = splits_at_blanks(self.tokenizer)
        self.reset()

    def reset(self) -> None:
        self.places: dict[str, int] = {}
        self.starts, self.ends, self.begins, self.counts, self.lengths = (Growing() for _ in range(5))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).offsets, np.int64).reshape(-1, 2)

    def learn(self, new: list[str]) -> None:
        fit = [u for u in new if not u[-1].isspace() and (u[0] in " \n" or not u[0].isspace())]
        self.places.update(dict.fromkeys(set(new).difference(fit), -1))
        for i in range(0, len(fit), self.TOGETHER):
            self.add(fit[i : i + self.TOGETHER])

    def add(self, new: list[str]) -> None:
        """Encode units as one text; one that begins a text gets a line feed before it, which is a token of its own."""
        put = np.array([u[0] not in " \n" for u in new])
        lengths = np.array([len(u) for u in new])
        ends = np.cumsum(lengths + put)
        begins = ends - lengths - put
        spans = self.whole("".join("\n" + u if p else u for u, p in zip(new, put.tolist(), strict=True)))
        owner = np.searchsorted(begins, spans[:, 0], side="right") - 1
        spans = spans - (begins + put)[owner][:, None]
        own = spans[:, 1] > 0  # all but the line feeds put in
        owner, spans = owner[own], spans[own]
        counts = np.bincount(owner, minlength=len(new))
        if (spans[:, 0] < 0).any() or (spans[:, 1] > lengths[owner]).any() or not counts.all():
            if len(new) == 1:
                self.places[new[0]] = -1
            else:
                self.add(new[: len(new) // 2])
                self.add(new[len(new) // 2 :])
            return
        self.places.update(zip(new, range(self.counts.n, self.counts.n + len(new)), strict=True))
        self.begins.append(self.starts.n + np.cumsum(counts) - counts)
        self.starts.append(spans[:, 0])
        self.ends.append(spans[:, 1])
        self.counts.append(counts)
        self.lengths.append(lengths)

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Spans of all texts one after another, as if the texts were joined, and the number of tokens of each text."""
        if len(self.places) > self.KEPT:
            self.reset()
        cut = [units(t) if self.by_unit else None for t in texts]
        self.learn(list(set().union(*filter(None, cut)).difference(self.places)))
        value, out, per_text = self.places.__getitem__, [np.zeros((0, 2), np.int64)], []
        run: list[list[int]] = []
        base = run_base = 0

        def flush() -> None:
            nonlocal run
            if run:
                at, sizes = np.array([p for places in run for p in places]), [len(places) for places in run]
                n, lengths = self.counts[at], self.lengths[at]
                tokens, shift = spread(self.begins[at], n), np.repeat(run_base + np.cumsum(lengths) - lengths, n)
                out.append(np.stack((self.starts[tokens] + shift, self.ends[tokens] + shift), axis=1))
                per_text.extend(np.add.reduceat(n, np.cumsum([0, *sizes[:-1]])).tolist())
                run = []

        for text, parts in zip(texts, cut, strict=True):
            places = list(map(value, parts)) if parts else [-1]
            if min(places) < 0:
                flush()
                out.append(self.whole(text) + base)
                per_text.append(len(out[-1]))
                run_base = base + len(text)
            else:
                run.append(places)
            base += len(text)
            if not run:
                run_base = base
        flush()
        return np.concatenate(out), np.array(per_text, np.int64)
