"""Token ids by the tokenizers library, fast on running prose: each space-led word is encoded once and remembered."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space, in the widest reading, other than the plain space.
_ODD = "\\t\\n\\r\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPLIT = re.compile(f" (?![ {_ODD}]|\\Z)")
_EXOTIC = re.compile(f" [{_ODD}]")
#: Runs that byte-level pre-tokenizers keep together; texts of other shapes are encoded whole.
_RUNS = re.compile(r"[^\W\d_]+|[!-&(-/:-@\[-`{-~]+|[0-9]+|\n(?=[^\s])")
#: ASCII punctuation but the apostrophe, which may lead a contraction, and the less-than sign, which may lead a special token.
_MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
#: How byte-level vocabularies write the byte of a space.
_SPACE = "Ġ"


def strings(x: pa.Array) -> list[str]:
    return x.to_numpy(zero_copy_only=False).tolist()


def pieces(texts: list[str]) -> pa.ListArray:
    """Each text cut before each space that a visible character follows; that space is left out.

    Byte-level pre-tokenizers always cut there, as white space joins a word only as one leading space, so the pieces
    can be encoded apart: the first as it is, the others with their space.
    """
    cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
    odd = [i for i, t in enumerate(texts) if "  " in t or t[:1] == " " or t[-1:] == " " or _EXOTIC.search(t)]
    if not odd:
        return cut
    order = np.arange(len(texts))
    order[odd] = len(texts) + np.arange(len(odd))
    return pa.concat_arrays([cut, pa.array([_SPLIT.split(texts[i]) for i in odd], cut.type)]).take(pa.array(order))


class Known:
    """Ids of remembered strings, end to end in one array, and how often each was asked for."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int):
        self.learn, self.most = learn, most
        self.at: dict[str, int] = {}
        self.start, self.n, self.uses, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def where(self, names: list[str]) -> np.ndarray:
        """Numbers of the names, all different; those not known yet are learnt: their ids end to end, and how many each has."""
        if len(self.at) > self.most:
            self.shrink()
        which = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(which < 0)
        if len(new):
            fresh = [names[k] for k in new.tolist()]
            ids, n = self.learn(fresh)
            which[new] = len(self.n) + np.arange(len(new))
            self.at.update(zip(fresh, which[new].tolist()))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n])
            self.n, self.ids = np.concatenate([self.n, n]), np.concatenate([self.ids, ids])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.uses[which] += 1
        return which

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings numbered ``which``, end to end, and how many each has."""
        return gathered(self.ids, self.start[which], self.n[which])

    def shrink(self) -> None:
        """Forget what was asked for least, until at most half of ``most`` is left; old uses count half."""
        least = 2
        while np.count_nonzero(self.uses >= least) > self.most // 2:
            least *= 2
        keep = np.flatnonzero(self.uses >= least)
        names, uses = list(self.at), self.uses[keep] // 2
        self.at, (self.ids, self.n) = {names[k]: i for i, k in enumerate(keep.tolist())}, self.take(keep)
        self.start, self.uses = np.cumsum(self.n) - self.n, uses


def gathered(ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of n ids from each start, end to end; and n."""
    return ids[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())], n


def counted(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, "<u4"), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))


class Encoder:
    """encode(texts) equals Tokenizer.encode(text, add_special_tokens=False).ids; ``words`` bounds the words that are
    remembered between groups of texts, and the other pieces.

    Most pieces (space-led words with what sticks to them) are letters and marks behind, which the pre-tokenizer keeps
    apart: letters are remembered as space-led words, marks as they are. Other pieces are remembered whole.
    """

    def __init__(self, path: str, words: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = 1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.leads = np.array([(self.tokenizer.id_to_token(i) or "").startswith(_SPACE) for i in range(size)])
        self.parts, self.odd = Known(self._learn_parts, words), Known(self._learn_odd, words // 4)

    def _encode(self, texts: list[str], some: int = 4096) -> list[np.ndarray]:
        of = self.tokenizer.encode_batch_fast
        return [np.array(x.ids, "<u4") for k in range(0, len(texts), some) for x in of(texts[k : k + some], add_special_tokens=False)]

    def _learn_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters count as space-led words, many in one text: its ids are cut where a token begins with the space, as
        the pre-tokenizer cuts before each such word and no other token of it begins so. Marks are encoded one by one."""
        word = np.fromiter(map(str.isalpha, parts), bool, len(parts))
        words = [p for p, w in zip(parts, word.tolist()) if w]
        every = counted(self._encode([" " + " ".join(words[k : k + 256]) for k in range(0, len(words), 256)], 16))[0]
        marks, n_marks = counted(self._encode([p for p, w in zip(parts, word.tolist()) if not w]))
        n = np.zeros(len(parts), np.int64)
        n[word], n[~word] = np.diff(np.append(np.flatnonzero(self.leads[every]), len(every)))[: len(words)], n_marks
        ids, of_word = np.zeros(n.sum(), "<u4"), np.repeat(word, n)
        ids[of_word], ids[~of_word] = every, marks
        return ids, n

    def _learn_odd(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Space-led pieces of other shapes, by the runs that the pre-tokenizer keeps apart or as one text."""
        runs, n = [], []
        for piece in pieces:
            found = _RUNS.findall(piece)
            whole = not found or sum(map(len, found)) != len(piece) or "<" in piece and any(t in piece for t in self.special)
            runs += [" " + piece] if whole else [" " + found[0], *found[1:]]
            n.append(1 if whole else len(found))
        of = {run: k for k, run in enumerate(dict.fromkeys(runs))}
        known = self._encode(list(of))
        ids, sizes = counted([known[of[run]] for run in runs])
        return ids, np.add.reduceat(sizes, np.cumsum(n) - n)

    def encode(self, texts: Iterable[str], group: int = 2_000_000) -> Iterator[np.ndarray]:
        """Ids of each text; new words are learnt together for texts of about ``group`` characters."""
        held, chars = [], 0
        for text in texts:
            held.append(text)
            chars += len(text)
            if chars >= group:
                yield from self._ids(held)
                held, chars = [], 0
        if held:
            yield from self._ids(held)

    def _table(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, n) of space-led pieces, all different."""
        bodies = pc.utf8_rtrim(pieces, _MARKS)
        of_word = pc.utf8_is_alpha(bodies)
        word = of_word.to_numpy(zero_copy_only=False)
        bodies, whole = bodies.filter(of_word), pieces.filter(of_word)
        coded = bodies.dictionary_encode()
        longer = pc.not_equal(pc.binary_length(bodies), pc.binary_length(whole))
        tails = [x[n:] for x, n in zip(strings(whole.filter(longer)), pc.utf8_length(bodies.filter(longer)).to_numpy().tolist())]
        number = {tail: k for k, tail in enumerate(dict.fromkeys(["", *tails]))}
        at = self.parts.where([*strings(coded.dictionary), *number])
        marks = at[len(coded.dictionary) :]
        which = np.full((len(whole), 2), marks[0])
        which[:, 0] = at[coded.indices.to_numpy()]
        which[longer.to_numpy(zero_copy_only=False), 1] = marks[np.fromiter(map(number.__getitem__, tails), np.int64, len(tails))]
        ids, n = self.parts.take(which.ravel())
        more, m = self.odd.take(self.odd.where(strings(pieces.filter(pc.invert(of_word)))))
        sizes = np.zeros(len(pieces), np.int64)
        sizes[word], sizes[~word] = n.reshape(-1, 2).sum(axis=1), m
        start = np.zeros(len(pieces), np.int64)
        start[word], start[~word] = np.cumsum(sizes[word]) - sizes[word], len(ids) + np.cumsum(m) - m
        return np.concatenate([ids, more]), start, sizes

    def _ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        cut = pieces(texts)
        begin, every = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py(), cut.flatten()
        later = np.ones(len(every), bool)
        later[begin] = False
        coded = every.filter(pa.array(later)).dictionary_encode()
        table, start, sizes = self._table(coded.dictionary)
        at = coded.indices.to_numpy()
        ids, n = gathered(table, start[at], sizes[at])
        ends = np.concatenate([[0], np.cumsum(n)])[np.append(begin[1:] - np.arange(1, len(begin)), len(n))]
        for head, a, b in zip(self._encode(strings(every.take(pa.array(begin)))), np.concatenate([[0], ends[:-1]]), ends):
            yield np.concatenate([head, ids[a:b]])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One Encoder a worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
