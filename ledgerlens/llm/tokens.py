"""Public tokenizer files inside Python workers.

``encoder(path)`` loads a file once in each worker.  A ``.json`` file is read
by ``tokenizers``.  Where that file is a plain byte-level BPE (no normalizer,
merges in the order of their ids), its own vocabulary is also given to
``tiktoken``, which returns the same ids several times faster;
``tests/llm/test_tokens.py`` holds both against each other.  A ``.tiktoken``
file goes to ``tiktoken``, a ``.model`` file to ``sentencepiece``.  Special
strings inside a text become their special ids, as is the default of
``tokenizers``; begin and end tokens are never added.
"""

from __future__ import annotations

import base64
import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np

#: Fixed value: the split pattern of the byte-level BPE family.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A byte-level BPE never joins the bytes on both sides of these places: before
#: a single blank or line feed between two visible ASCII characters, and between
#: an ASCII letter and a following stop mark.
SAFE_CUT = re.compile(r"(?<=[!-~])(?=[ \n][!-~])|(?<=[A-Za-z])(?=[.,;:!?])")

Encode = Callable[[str], np.ndarray]


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a plain byte-level BPE file, or None for any other kind."""
    model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not spec.get("normalizer")
        and not model.get("dropout")
        and not model.get("ignore_merges")
        and all(
            t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])
            for t in spec.get("added_tokens", [])
        )
    )
    if not plain:
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    alphabet = _byte_alphabet()
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    if any(c not in alphabet for k in vocab for c in k):
        return None
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    singles = sorted(v for k, v in vocab.items() if len(k) == 1)
    if None in merged or merged != sorted(merged) or len(singles) != 256 or singles[-1] > merged[0]:
        return None
    if len(vocab) != 256 + len(merged):
        return None
    return {bytes(alphabet[c] for c in k): v for k, v in vocab.items()}


def _from_ranks(ranks: dict[bytes, int], special: dict[str, int]) -> Encode:
    import tiktoken

    enc = tiktoken.Encoding(
        "byte_level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special
    )
    allowed = set(special)
    return lambda text: enc.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())


def library_encoder(path: str) -> Encode:
    """The file's own library, without the faster path."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    if path.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: np.array(p.encode(text, num_threads=1), dtype=np.uint32)
    if path.endswith(".tiktoken"):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return _from_ranks(ranks, {})
    raise ValueError(f"unknown tokenizer file {path!r}")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> tuple[Encode, bool]:
    """(text -> ids, whether texts may be cut at ``SAFE_CUT``) for a file."""
    library = library_encoder(path)
    if path.endswith(".tiktoken"):
        return library, True
    if not path.endswith(".json"):
        return library, False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = _byte_level_ranks(spec)
    if ranks is None:
        return library, False
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    if any(SAFE_CUT.search(s) for s in special):
        return library, False
    fast = _from_ranks(ranks, special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast(text)
        except Exception:  # its pattern engine has a depth limit that the library lacks
            return library(text)

    return encode, True


def pieces(text: str, cut: bool, chars: int) -> Iterator[str]:
    """``text`` in parts of about ``chars`` characters, cut only at safe places.

    A part runs on to the next safe place, so a text without any stays whole;
    the ids of the parts, one after another, are the ids of the text.
    """
    if not cut or len(text) <= chars:
        yield text
        return
    at = 0
    while len(text) - at > chars:
        found = SAFE_CUT.search(text, at + chars)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def text_of(value: bytes | None) -> str:
    """UTF-8 bytes of a row as a text; null is empty, broken bytes are replaced."""
    return "" if value is None else value.decode("utf-8", errors="replace")
