"""Quality rules on tokeniser fertility.

A public vocabulary measures each text: characters per token, share of
tokens that are raw bytes of a character (the byte fallback) and entropy of
the token distribution.  A text is rejected when a measure leaves the band
of its language, or of its main script when the language has none, and when
less than half of it are letters.  Bands
are fixed parameters, so a verdict depends on the text alone and the rule
is one narrow pass without a shuffle.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, text_slices, vocabulary, words, worker_held

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The split of the rank files into parts (fixed value, given with the vocabularies).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
_SYMBOLS = "#*$%&|<>"


class ByteVocabulary:
    """A byte-level vocabulary of ranks; texts are encoded in parts that bound the encoder's stack."""

    PART = 1 << 16

    def __init__(self, path: str):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.raw = np.zeros(self.size, bool)  # tokens that are no whole characters
        for token, rank in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.raw[rank] = True

    @classmethod
    def load(cls, path: str) -> "ByteVocabulary":
        return worker_held(("bytes", path), lambda: cls(path))

    def encode(self, text: str) -> np.ndarray:
        text = text.encode("utf-8", "replace").decode()  # lone surrogates
        if len(text) <= self.PART:
            return np.asarray(self.coder.encode_to_numpy(text, disallowed_special=()))
        parts, at = [], 0
        while at < len(text):
            stop = at + self.PART
            if stop < len(text):  # cut before a space between words where there is one
                space = text.rfind(" ", at + 1, stop)
                stop = space if space > at else stop
            parts.append(np.asarray(self.coder.encode_to_numpy(text[at:stop], disallowed_special=())))
            at = stop
        return np.concatenate(parts)


@dataclass(frozen=True)
class Band:
    """Least and most characters per token, most byte-fallback share, least entropy (bits) of a text with many tokens.

    Few characters per token (under ``random_chars``) together with a high
    entropy (over ``random_entropy``) mark random strings.
    """

    chars_low: float
    chars_high: float
    bytes_high: float
    entropy_low: float
    random_chars: float = 0.0
    random_entropy: float = 0.0


#: Bands per script (fixed values, production vocabulary): the floors lie between random strings and the lowest of
#: the natural samples measured (Latin 1.93, Greek 1.95, Arabic 1.55, Hebrew 1.78, Chinese 0.85 characters per token).
#: Scripts that the vocabulary has no tokens for are all raw bytes, but of few kinds: up to 4.4 bits where their
#: share is high, against 4.8 and more for random characters.
SCRIPTS = {
    "LATIN": Band(1.85, 7.0, 0.08, 5.0),
    "CYRILLIC": Band(1.2, 6.0, 0.40, 4.5, 1.45, 6.0),
    "GREEK": Band(1.4, 6.0, 0.60, 4.0),
    "ARABIC": Band(1.2, 7.0, 0.25, 4.0),
    "HEBREW": Band(1.2, 7.0, 0.50, 4.0),
    "CJK": Band(0.5, 3.0, 0.90, 4.0),
    "OTHER": Band(0.2, 7.0, 1.00, 3.0, 0.75, 4.7),
}
#: Bands per language, looked up before the script (fixed values): below the clean labelled texts (least characters per
#: token en 2.34, de 2.33, fr 2.12, es 2.21; most byte share 0.018, 0.052, 0.048, 0.038).  The letters of kk and mn
#: are partly bytes, as are those of grc.
LANGUAGES = {
    "en": Band(2.1, 7.0, 0.05, 5.0),
    "de": Band(2.02, 7.0, 0.07, 5.0),
    "fr": Band(2.02, 7.0, 0.06, 5.0),
    "es": Band(2.05, 7.0, 0.05, 5.0),
    "kk": Band(1.2, 6.0, 0.40, 4.5),
    "mn": Band(1.1, 6.0, 0.40, 4.5),
    "grc": Band(0.5, 6.0, 0.90, 4.0),
}
#: Least share of letters (bytes of characters beyond ASCII count as such) among the bytes that are not white space.
LETTERS_LOW = 0.5
_LETTERS = bytes([*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)])
_WHITE = b" \t\n\r\x0b\x0c"
_CJK = ("CJK", "HIRAGANA", "KATAKANA", "HANGUL")
_script_of: dict[str, str] = {}


def main_script(text: str) -> str:
    """Script of most letters (LATIN for ASCII text and for text without letters)."""
    if text.isascii():
        return "LATIN"
    counts: dict[str, int] = {"LATIN": len(re.findall("[A-Za-zÀ-ÖØ-öø-ɏ]", text))}
    for c in re.findall(r"[^\W\d_A-Za-zÀ-ÖØ-öø-ɏ]", text):
        script = _script_of.get(c)
        if script is None:
            name = unicodedata.name(c, "OTHER").split(" ")[0].split("-")[0]
            script = _script_of[c] = "CJK" if name in _CJK else name if name in SCRIPTS else "OTHER"
        counts[script] = counts.get(script, 0) + 1
    return max(sorted(counts), key=counts.__getitem__) if any(counts.values()) else "LATIN"


def base_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    found = words(text)
    seen, doubled = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            if line in seen:
                doubled += 1
            seen.add(line)
    return (len(found), sum(map(len, found)), sum(map(text.count, _SYMBOLS)), doubled, repeat_words(found))


def repeat_words(found: list[str]) -> int:
    """Words that lie in a three-word window found twice or more."""
    n = len(found) - 2
    if n < 2:
        return 0
    code: dict[str, int] = {}
    put = code.setdefault
    c = np.array([put(w, len(code)) for w in found], np.int64)
    if len(code) < 1 << 21:
        key = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    else:  # rank the pairs first, so that three words still fit 64 bits
        _, pair = np.unique(c[:-2] * len(code) + c[1:-1], return_inverse=True)
        key = pair * len(code) + c[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(found), bool)
    for k in range(3):
        inside[k:n + k] |= twice
    return int(inside.sum())


def fertility(text: str, vocab: ByteVocabulary) -> tuple[float, float, float, int]:
    """(characters per token, byte-fallback share, entropy in bits, tokens)."""
    ids = vocab.encode(text)
    if not len(ids):
        return 0.0, 0.0, 0.0, 0
    counts = np.bincount(ids) if len(ids) > 20_000 else np.unique(ids, return_counts=True)[1]
    share = counts[counts > 0] / len(ids)
    return len(text) / len(ids), float(vocab.raw[ids].mean()), float(-(share * np.log2(share)).sum()), len(ids)


def has_letters(text: str) -> bool:
    """Whether the text is of words rather than digits and signs, which belong to no language or script."""
    raw = text.encode("utf-8", "replace").translate(None, _WHITE)
    return len(raw) - len(raw.translate(None, _LETTERS)) >= LETTERS_LOW * len(raw)


def in_band(band: Band, chars: float, fallback: float, entropy: float, tokens: int) -> bool:
    """The entropy floor holds for texts whose token count could reach it with room to spare."""
    least = min(band.entropy_low, 0.75 * np.log2(max(tokens, 2)))
    if chars < band.random_chars and entropy > band.random_entropy:
        return False
    return band.chars_low <= chars <= band.chars_high and fallback <= band.bytes_high and entropy >= least


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  vocabulary_path: str | None = None, languages: dict[str, Band] = LANGUAGES,
                  scripts: dict[str, Band] = SCRIPTS) -> DataFrame:
    """docs with the measures of its texts and the verdict ``kept``; one narrow pass.

    Added columns: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, chars_per_token, byte_share,
    token_entropy, kept; columns of docs with such names are replaced.  A
    null or empty text has zero measures, fails the base rule and is not
    kept; a null or unknown language uses the band of the text's script.
    Repeated rows get the same values; an empty table gives an empty table.
    """
    path = vocabulary_path or vocabulary(VOCABULARY)
    added = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
             "chars_per_token double, byte_share double, token_entropy double, kept boolean")
    new = [c.split()[0] for c in added.split(", ")]
    base = docs.drop(*[c for c in new if c not in (id_col, text_col, lang_col)])
    if lang_col not in base.columns:
        base = base.withColumn(lang_col, F.lit(None).cast("string"))
    lang_at = base.columns.index(lang_col)
    schema = extended(base.schema, added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = ByteVocabulary.load(path)
        types = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 3 + [pa.bool_()]
        for part, texts in text_slices(batches, text_col):
            rows = []
            for text, lang in zip(texts, part.column(lang_at).to_pylist()):
                m = base_measures(text)
                failed = m[0] < MIN_WORDS or 100 * m[4] > MAX_REPEAT_PERCENT * m[0]
                chars, fallback, entropy, tokens = fertility(text, vocab) if text else (0.0, 0.0, 0.0, 0)
                band = languages.get(lang) or scripts[main_script(text or "")]
                judged = chars, fallback, entropy, tokens
                if not failed and text.isupper():  # capitals have few tokens of their own: the bands are those of lower case
                    judged = fertility(text.lower(), vocab)
                kept = not failed and bool(in_band(band, *judged)) and has_letters(text)
                rows.append((*m, failed, chars, fallback, entropy, kept))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), types))],
                                             names=[*part.schema.names, *new])

    return base.mapInArrow(run, schema)
