"""Cutting a text where a tokenizer cuts it anyway, so that pieces can be encoded once and remembered.

For two layouts of tokenizer files a space between two other characters that are no white space is always a border
between tokens: byte-level pieces that take one leading space, and words from which white space is dropped. Encoding
piece by piece then gives the ids of the whole text. Any other layout is encoded whole.
"""

from __future__ import annotations

import json
import os
import re

_WIDE = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def spaced_pieces(text: str) -> list[str]:
    """Pieces of a text for the byte-level layout; joined they are the text."""
    if not text:
        return []
    if _WIDE.search(text):
        return _SAFE.split(text)
    # No white space touches other white space: every space and line feed starts a piece.
    first, *rest = text.replace("\n", " \n").split(" ")
    pieces = [x if x[:1] == "\n" else " " + x for x in rest]
    return [first, *pieces] if first else pieces


def dropped_pieces(text: str) -> list[str]:
    """Pieces of a text for the layout that drops white space; spaces and line feeds are left out."""
    return text.replace("\n", " ").split(" ")


def layout(path: str):
    """The function that cuts texts for the tokenizer in the file, or None if they must be encoded whole."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokens = [x["content"] for x in spec.get("added_tokens", [])]
    if any(c.isspace() for x in tokens for c in x) or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec.get("added_tokens", [])):
        return None
    pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True):
        return spaced_pieces
    steps = [x["type"] for x in pre.get("pretokenizers", [])]
    split = pre.get("pretokenizers", [{}])[0]
    drops = steps == ["Split", "ByteLevel"] and split["behavior"] == "Removed" and split["invert"] and r"\s" in split["pattern"].get("Regex", "")
    if drops and [x["type"] for x in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        return dropped_pieces
    return None


#: The pattern of words of CLIP's tokenizer.
_CLIP = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def letters_are_words(path: str) -> bool:
    """Whether the tokenizer in the file has the layout that drops white space and takes letters between white space as one
    word, which its model then gets in lower case, by bytes."""
    if layout(path) is not dropped_pieces:
        return False
    with open(path, encoding="utf-8") as f:
        split, byte_level = json.load(f)["pre_tokenizer"]["pretokenizers"]
    return split["pattern"].get("Regex") == _CLIP and not byte_level["add_prefix_space"] and not byte_level.get("use_regex", True)


def loaded(path: str):
    """The tokenizers library's tokenizer of the file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out
