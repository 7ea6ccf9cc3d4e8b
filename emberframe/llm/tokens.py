"""Token ids of whole texts with a public byte-level tokenizer, inside tasks.

The tokenizer splits a text into words before it merges bytes, and a word never spans the place before a
space that follows another sign. So a text is cut there, each distinct piece is encoded once by the library,
and the pieces' ids are joined. Texts with runs of spaces, where that does not hold, are encoded whole.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
from tokenizers import Tokenizer

#: Pieces kept by each worker; then it starts anew.
CACHE = 1_000_000
#: Code points whose words are looked up together; longer texts are cut there.
GROUP = 1 << 19
PUNCTUATION = ".,;:!?"
#: Where pieces would not give the same ids as the whole.
RUNS = re.compile(r"   |  \Z")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as packed little-endian unsigned integers of ``kind``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes that each id stands for
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        self.words: dict[str, bytes] = {}  # by word, with the space before it
        self.pieces: dict[str, bytes] = {}  # without one

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    @staticmethod
    def _atoms(piece: str) -> list[str]:
        """A piece as parts that the tokenizer's words never span: lines, and words before their punctuation."""
        lines = piece.split("\n")
        if len(lines) > 1 and not all(x and not x[-1].isspace() and (k == 0 or not x[0].isspace()) for k, x in enumerate(lines)):
            return [piece]
        out = []
        for k, line in enumerate(lines):
            if k:
                out.append("\n")
            word = line.rstrip(PUNCTUATION)
            if len(word) < len(line) and word[-1:].isalpha():
                out += (word, line[len(word) :])
            else:
                out.append(line)
        return out

    def _learn(self, missing: set[str]) -> None:
        """Ids of words that follow a space; words of letters and their punctuation apart."""
        letters, ended, split = set(), [], {}
        for word in missing:
            if word.isalpha():
                letters.add(word)
            elif word[-1:] and word[-1] in PUNCTUATION and word[:-1].isalpha():
                ended.append(word)
            else:
                split[word] = self._atoms(" " + word)
        stems = {word[:-1] for word in ended}
        atoms = {word[-1] for word in ended}
        for atom in (x for parts in split.values() for x in parts):
            if atom[0] == " " and atom[1:].isalpha():
                stems.add(atom[1:])
            else:
                atoms.add(atom)
        letters.update(x for x in stems if x not in self.words)
        atoms = [x for x in atoms if x not in self.pieces]
        bare = [x for x in atoms if x.isalpha()]
        other = [x for x in atoms if not x.isalpha()]
        self.pieces.update(zip(other, self._whole(other)))
        self.pieces.update(self._run(bare, [x for atom in bare for x in (atom, "\n")]))
        self.words.update(self._run(list(letters), [" " + x for x in letters]))
        for word in ended:
            self.words[word] = self.words[word[:-1]] + self.pieces[word[-1]]
        for word, parts in split.items():
            spaced = parts[0][1:] if parts[0][1:].isalpha() else None
            head = self.words[spaced] if spaced else self.pieces[parts[0]]
            self.words[word] = b"".join([head, *map(self.pieces.__getitem__, parts[1:])])

    def _run(self, atoms: list[str], run: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words of letters and their ids, encoded as one text and cut by the bytes that each id stands for."""
        if not atoms:
            return iter(())
        packed = self._whole(["".join(run)])[0]
        ends = np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in run])
        cuts = np.searchsorted(np.cumsum(self.sizes[np.frombuffer(packed, self.kind)]), ends) + 1
        bounds = [0, *(cuts * self.kind.itemsize).tolist()]
        step = len(run) // len(atoms)
        return zip(atoms, (packed[a:b] for a, b in zip(bounds[:-1:step], bounds[1::step])))

    def _learn_bare(self, pieces: set[str]) -> dict[str, list[str]]:
        """Atoms of pieces that follow no space, the first ones of texts; all of them are known afterwards."""
        atoms = {piece: self._atoms(piece) for piece in pieces}
        missing = list({x for own in atoms.values() for x in own}.difference(self.pieces))
        if missing:
            self.pieces.update(zip(missing, self._whole(missing)))
        return atoms

    def _group(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without runs of spaces; what is new in any of them is encoded together."""
        if len(self.words) + len(self.pieces) > CACHE:
            self.words, self.pieces = {}, {}
        rows = [text.split(" ") for text in texts]
        firsts = [row.pop(0) for row in rows]
        fresh = set().union(*rows).difference(self.words)
        if fresh:
            self._learn(fresh)
        atoms = self._learn_bare({x for x in firsts if x})
        word, piece = self.words.__getitem__, self.pieces.__getitem__
        return [b"".join([*map(piece, atoms.get(first, ())), *map(word, row)]) for first, row in zip(firsts, rows)]

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of whole texts, in order; none for a null or empty one. At most about two GROUPs are held."""
        ready: list[bytes | None] = []
        group, size = [], 0
        for text in texts:
            if text and len(text) <= GROUP and not RUNS.search(text):
                ready.append(None)
                group.append(text)
                size += len(text)
            else:
                ready.append(self.encode(text) if text else b"")
            if size > GROUP:
                yield from self._filled(ready, group)
                ready, group, size = [], [], 0
        yield from self._filled(ready, group)

    def _filled(self, ready: list[bytes | None], group: list[str]) -> Iterator[bytes]:
        found = iter(self._group(group) if group else ())
        return (next(found) if x is None else x for x in ready)

    def encode(self, text: str | None) -> bytes:
        """Ids of one whole text; none for a null or empty one."""
        if not text:
            return b""
        if RUNS.search(text):
            return self._whole([text])[0]
        return b"".join(x for part in _parts(text) for x in self._group([part]))


def _parts(text: str, size: int = GROUP) -> Iterator[str]:
    """A long text in parts that begin at a space between two other signs."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while 0 < cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut <= 0 or cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path)
