"""The encoders of the public vocabularies, loaded once per Python worker."""

from __future__ import annotations

import base64
import functools
import json
import os
import re

import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

EOS = 1  # the id that ends a packed document

#: The white space of the public pattern: Unicode's, which Python's own class exceeds by four control characters.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Without the look-ahead branch, whose engine is slower and overflows on long runs of white space.
_PLAIN = public_tokenizers.PATTERN.replace(r"\s+(?!\S)|", "")
#: The branch parts the last of several white-space characters from the others where another character follows.
_LAST = re.compile(f"[{SPACE}][{SPACE}][^{SPACE}]")


@functools.lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankEncoder:
    """Encodes text by ranks, each match of the public pattern separately, without special tokens.

    The text is cut by the rule of the look-ahead branch, and its parts are encoded without that branch, so
    that time grows with the length of the text whatever it holds.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.plain = tiktoken.Encoding("plain", pat_str=_PLAIN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        at, out = 0, []
        for m in _LAST.finditer(text):
            cut = m.start() + 1
            out += self.plain.encode_ordinary(text[at:cut])
            at = cut
        last = self.plain.encode_ordinary(text[at:] if at else text)
        return out + last if at else last


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves,
    the others follow from code point 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def same_as_ranks(file: dict, ranks: dict[bytes, int]) -> bool:
    """Whether a tokenizer file encodes as ``ranks`` do under the public pattern: byte-level, nothing normalised
    or prefixed, with the same token for every id and merges in the order of the ids."""
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    plain = not file.get("normalizer") and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True):
        return False
    alphabet = _byte_alphabet()
    special = {t["content"] for t in file.get("added_tokens", [])}
    spelled = {t: i for t, i in model["vocab"].items() if t not in special}
    if any(c not in alphabet for t in spelled for c in t):
        return False
    merged = [spelled.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    ordered = None not in merged and all(a < b for a, b in zip(merged, merged[1:])) and len(merged) + 256 == len(spelled)
    return ordered and {bytes(map(alphabet.__getitem__, t)): i for t, i in spelled.items()} == ranks


class WordTokenizer:
    """A byte-level BPE file of the tokenizers library, encoded as that library encodes it.

    Texts without any special token's string go through the rank encoder over the same vocabulary, which
    gives the same ids faster; the others, and files that ``same_as_ranks`` does not find equal, go through the
    library itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        beside = os.path.splitext(path)[0] + ".tiktoken"
        self.ranks = None
        if os.path.exists(beside):
            with open(path) as f:
                if same_as_ranks(json.load(f), ranks := ranks_of(beside)):
                    self.ranks = RankEncoder(ranks)

    @staticmethod
    @functools.lru_cache(maxsize=4)
    def load(path: str) -> WordTokenizer:
        return WordTokenizer(path)

    def encode(self, text: str) -> list[int]:
        if self.ranks and not any(s in text for s in self.special):
            return self.ranks.encode(text)
        return self.library.encode(text, add_special_tokens=False).ids
