"""Token ids of whole texts, by the tokenizers library, a word at a time.

The word tokenizer never joins characters across ASCII white space, so the ids
of a text are those of its words in order.  Each worker keeps the ids of words
that it has seen (at most ``memo`` words; then it starts afresh), and encodes
the letters of unseen words together, parted by the tokens' end-of-word mark.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO = 500_000
#: Longer words are encoded alone and not kept.
LONG = 200
CLOSING = b".,;:!?"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memo: int = MEMO) -> None:
        self.most = memo
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For lower-case ASCII letters, normalisation and the split into pieces change nothing.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.memo: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True

    def _alone(self, word: bytes) -> bytes:
        return np.asarray(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, tokenizer, words: list[bytes]) -> dict[bytes, bytes]:
        """Words of letters only: each is one piece of BPE, so the last token of each has the end mark."""
        out: dict[bytes, bytes] = {}
        for i in range(0, len(words), 512):
            part = words[i : i + 512]
            ids = np.asarray(tokenizer.encode_batch_fast([b" ".join(part).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):  # a letter that folds to several characters
                out.update((w, self._alone(w)) for w in part)
                continue
            data, at = ids.tobytes(), 0
            for w, cut in zip(part, (4 * cuts).tolist(), strict=True):
                out[w] = data[at:cut]
                at = cut
        return out

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words.

        ASCII case is folded and closing punctuation, a piece of its own after a
        letter, split off; only what is left is kept for later.
        """
        memo = self.memo
        out = list(map(memo.get, words))
        wait: list[tuple[int, bytes, bytes]] = []
        unknown: dict[bytes, bytes] = {}
        for i, ids in enumerate(out):
            if ids is None:
                w = words[i]
                lower = w.lower() if w.isascii() else w
                core = lower.rstrip(CLOSING)
                if len(w) <= LONG and (core.isalpha() if core.isascii() else unicodedata.normalize("NFC", core.decode("utf-8", "replace")).lower().isalpha()):
                    wait.append((i, core, lower[len(core) :]))
                    if core not in memo:
                        unknown[core] = b""
                else:
                    out[i] = ids = self._alone(w)
                    if len(w) <= LONG:
                        memo[w] = ids
        unknown |= self._letters(self.plain, [c for c in unknown if c.isascii()])
        unknown |= self._letters(self.tokenizer, [c for c in unknown if not c.isascii()])
        tails = {tail: self._alone(tail) if tail else b"" for tail in {t for _, _, t in wait}}
        for i, core, tail in wait:
            out[i] = (unknown[core] if core in unknown else memo[core]) + tails[tail]
        if len(memo) + len(unknown) > self.most:
            memo.clear()
        if len(unknown) <= self.most:
            memo.update(unknown)
        return out

    def encode_many(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of a string column."""
        parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = parts.flatten().dictionary_encode()
        of_word = self._ids(words.dictionary.cast(pa.binary()).to_pylist())
        sizes = np.fromiter(map(len, of_word), np.int64, len(of_word)) // 4
        ids = np.frombuffer(b"".join(of_word), "<u4")
        which = words.indices.to_numpy()
        n = sizes[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = ids[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist() if len(parts) else [0]
        return [out[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=4)
def encoder(path: str, memo: int = MEMO) -> WordEncoder:
    """One encoder for each tokenizer file and Python worker."""
    return WordEncoder(path, memo)
