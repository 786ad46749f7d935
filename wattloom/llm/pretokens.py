"""Exact tokenizer results from cached results of space-separated pre-tokens.

The tokenizer drops white space before its merges and no match of its splitting pattern holds any,
so the ids of a text are the ids of its runs of non-space bytes, joined. Special strings hold no
space either, so a run that contains one is encoded just as inside the text.
"""

from __future__ import annotations

import functools
import gc
import os
from collections.abc import Callable, Iterable

import numpy as np

CACHE_ENTRIES = 800_000


@functools.lru_cache(maxsize=2)
def tokenizer(name: str):
    """The tokenizer of a file: an absolute path, or a name among the public tokenizers."""
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))


def runs(text: bytes) -> list[bytes]:
    """Runs of non-space bytes of a UTF-8 text, in ASCII lower case where the ids stay the same.

    The tokenizer lower-cases after composing characters. Of composed characters only those made
    with U+0300 to U+036F (first byte CC or CD) have ASCII letters as base, so without these, and
    without ``<`` that special strings begin with, case can go first.
    """
    if b"<" in text or b"\xcc" in text or b"\xcd" in text:
        return text.split()
    return text.lower().split()


def unmarked(run: bytes) -> bytes:
    """The run without a comma or full stop that follows a letter or digit of ASCII: such a mark is
    a pre-token of its own."""
    return run[:-1] if run[-1] in b".," and run[-2:-1].isalnum() else run


@functools.lru_cache(maxsize=2)
def _ends_word(name: str) -> np.ndarray | None:
    """By id, whether a token ends a pre-token; None for tokenizers without word ends."""
    vocabulary = tokenizer(name).get_vocab()
    suffix = getattr(tokenizer(name).model, "end_of_word_suffix", None)
    if not suffix:
        return None
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return ends


def encode(name: str, runs: list[bytes], together: int = 100) -> list[bytes]:
    """The ids of each run as little-endian 32-bit numbers.

    Runs of letters only are encoded ``together`` with spaces between, which costs less, and cut
    where a token ends a word; a group in which that does not give one word per run is encoded
    run by run, as are all other runs.
    """
    model, ends = tokenizer(name), _ends_word(name)
    text = [run.decode("utf-8", "replace") for run in runs]
    out: list[bytes] = [b""] * len(runs)
    words = [i for i, t in enumerate(text) if t.isalpha()] if ends is not None else []
    groups = [words[i : i + together] for i in range(0, len(words), together)]
    lines = [" ".join([text[i] for i in group]) for group in groups]
    taken = set()
    for group, line in zip(groups, model.encode_batch_fast(lines, add_special_tokens=False)):
        ids = np.array(line.ids, "<u4")
        cuts = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(cuts) == len(group):
            flat, start = ids.tobytes(), 0
            for i, cut in zip(group, cuts):
                out[i] = flat[start:cut]
                start = cut
            taken.update(group)
    rest = [i for i in range(len(runs)) if i not in taken]
    single = model.encode_batch_fast([text[i] for i in rest], add_special_tokens=False)
    for i, one in zip(rest, single):
        out[i] = np.array(one.ids, "<u4").tobytes()
    return out


class Cache:
    """Run of bytes -> value for one Python worker, bounded; ``first`` entries always stay.

    ``value`` turns the ids of a run, as bytes, into something that can be added up.
    """

    def __init__(self, name: str, value: Callable, first: dict | None = None):
        self.name, self.value, self.first = name, value, first or {}
        self.known = dict(self.first)
        self.again: set[bytes] = set()  # met in more than one call

    def of(self, texts: Iterable[list[bytes]]) -> Callable:
        """Make every run of ``texts`` known and return the lookup."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and scans of a large cache cost much
        try:
            return self._of(texts)
        finally:
            if collecting:
                gc.enable()

    def _of(self, texts: Iterable[list[bytes]]) -> Callable:
        wanted = set().union(*texts)
        hits = wanted.intersection(self.known)
        misses = list(wanted.difference(hits))
        self.again |= hits
        if len(self.known) + len(misses) > CACHE_ENTRIES + len(self.first):
            # What was met twice stays, a third of the cache at most; the rest was met once so far.
            if len(self.again) > CACHE_ENTRIES // 3:
                self.again = hits
            self.known = self.first | {run: self.known[run] for run in self.again}
        if misses:
            known = self.known
            bodies = list(map(unmarked, misses))
            new = list({*bodies, b".", b","}.difference(known))
            known.update(zip(new, map(self.value, encode(self.name, new))))
            for run, body in zip(misses, bodies):
                if len(run) > len(body):
                    known[run] = known[body] + known[run[-1:]]
        return self.known.__getitem__
