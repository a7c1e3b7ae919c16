"""Quality rules, line first: rules judge each line, failing lines go, then documents that lost too much go.

Base counts (words, symbols, duplicate lines, repeated five-word windows) are exact over the whole text.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone.llm.common import SPACE, Words, mix64, per_text, ship, slices, span_hashes, utf8, windows


@dataclass(frozen=True)
class LineRules:
    """Thresholds. A line fails if any rule fires; a document is rejected if more than max_lost of its word bytes go."""

    min_bars: int = 3
    bars_per_word: float = 0.15  # navigation: "a | b | c"
    symbols_per_word: float = 0.5
    shout_share: float = 0.7  # upper-case letters of all letters, in lines of shout_words or more
    shout_words: int = 3
    min_terminated_words: int = 6  # longer lines have to end in punctuation
    max_boilerplate_words: int = 14
    max_lost: float = 0.5
    min_words: int = 10
    max_repeat_percent: int = 20


#: Phrases that mark a short line as boilerplate, as whole words in lower case, by language.
BOILERPLATE = {
    "en": ("all rights reserved", "released under the", "licensed under", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "click here", "sign in", "log in to", "subscribe to", "share on", "powered by", "skip to content"),
    "de": ("alle rechte vorbehalten", "lizenziert unter", "nutzungsbedingungen", "datenschutzerklärung", "cookies akzeptieren", "hier klicken", "jetzt anmelden", "newsletter abonnieren", "zum inhalt springen"),
    "fr": ("tous droits réservés", "sous licence", "conditions d'utilisation", "politique de confidentialité", "accepter les cookies", "cliquez ici", "se connecter", "abonnez-vous", "aller au contenu"),
    "es": ("todos los derechos reservados", "bajo la licencia", "condiciones de uso", "política de privacidad", "aceptar cookies", "haga clic aquí", "iniciar sesión", "suscríbete", "saltar al contenido"),
}
_PHRASES = [p.encode() for own in BOILERPLATE.values() for p in own]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_SENTENCE_ENDS = ".!?\u2026\u3002\uff01\uff0e\uff1f\u061f\u06d4\u0964"
_WORD = _UPPER | _LOWER
_WORD[48:58] = _WORD[128:] = True


def _last_characters(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of the UTF-8 characters that end at ends."""
    at = ends - 1
    code, shift, live = data[at].astype(np.int64), np.zeros(len(at), np.int64), np.flatnonzero(data[at] >= 128)
    code[live] &= 0x3F
    for _ in range(3):  # up to three bytes of the form 10xxxxxx stand before the last
        at[live] -= 1
        shift[live] += 6
        byte = data[np.maximum(at[live], 0)].astype(np.int64)
        follows = (byte & 0xC0) == 0x80
        size = np.where(byte >= 0xF0, 0x07, np.where(byte >= 0xE0, 0x0F, 0x1F))
        code[live] |= np.where(follows, byte & 0x3F, byte & size) << shift[live]
        live = live[follows]
    return code


def _by_character(codes: np.ndarray, test) -> np.ndarray:
    """test, of each distinct character once."""
    distinct, place = np.unique(codes, return_inverse=True)
    return np.array([test(chr(c)) for c in distinct], bool)[place]


def _closes(character: str) -> bool:
    """Whether a line may end so: in punctuation of any script but an opening bracket, in a digit, or in a symbol."""
    kind = unicodedata.category(character)
    return kind[0] in "PNS" and kind != "Ps"


def _again(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seen before, seen twice or more) of each value inside its group, in order of place."""
    key = mix64(value ^ mix64(group.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k), bool)
    same[1:] = k[1:] == k[:-1]
    both = same.copy()
    both[:-1] |= same[1:]
    before, twice = np.zeros(len(k), bool), np.zeros(len(k), bool)
    before[order], twice[order] = same, both
    return before, twice


def judge(data: np.ndarray, offsets: np.ndarray, rules: LineRules) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Columns for the texts of one slice, then the lines: start, end, failed."""
    n_docs = len(offsets) - 1
    words = Words(data, offsets)
    space = SPACE[data]
    symbol = _SYMBOL[data]
    hashes = span_hashes(data, words.start, words.end)

    grams, at = windows(words, hashes, 5)
    _, twice = _again(words.doc[at], grams)
    mark = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(mark, at[twice], 1)
    ends = at[twice] + 5
    np.add.at(mark, ends, -1)
    repeated = np.cumsum(mark[:-1]) > 0

    # Lines end at "\n" or at the end of their text.
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < max(len(data), 1)] if len(data) else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    end = np.concatenate([start[1:], [len(data)]]) if len(start) else start
    has_break = np.zeros(len(start), bool)
    if len(start):
        has_break = (data[end - 1] == 10) & (end > start)
    stop = end - has_break
    bounds = np.concatenate([start, [len(data)]])
    in_line = np.searchsorted(words.start, bounds)
    n_words = np.diff(in_line)
    worded = n_words > 0
    before = np.zeros(len(start), bool)
    before[worded], _ = _again(doc[worded], span_hashes(data, start[worded], stop[worded]))

    upper, lower = per_text(_UPPER[data], bounds), per_text(_LOWER[data], bounds)
    bars, symbols = per_text(data == 124, bounds), per_text(symbol, bounds)
    many = np.maximum(n_words, 1)
    failed = (bars >= rules.min_bars) & (bars >= rules.bars_per_word * many)
    failed |= (symbols - bars) >= rules.symbols_per_word * many
    failed |= (n_words >= rules.shout_words) & (upper >= rules.shout_share * np.maximum(upper + lower, 1)) & (upper > 0)
    # A line that holds a whole sentence is prose, however it ends.
    closing = _last_characters(data, words.end)
    ended = np.concatenate([[0], np.cumsum(_by_character(closing, _SENTENCE_ENDS.__contains__))])
    sentences = ended[in_line[1:]] - ended[in_line[:-1]]
    long = np.flatnonzero((n_words >= rules.min_terminated_words) & (sentences == 0))
    failed[long[~_by_character(closing[in_line[1:][long] - 1], _closes)]] = True
    failed |= before
    failed &= worded
    low = bytes(data).lower()
    for phrase in _PHRASES:
        p = low.find(phrase)
        while p >= 0:
            line = int(np.searchsorted(start, p, "right")) - 1
            q = p + len(phrase)
            inside = (p > start[line] and _WORD[data[p - 1]]) or (q < stop[line] and _WORD[data[q]])
            if n_words[line] <= rules.max_boilerplate_words and q <= stop[line] and not inside:
                failed[line] = True
            p = low.find(phrase, p + 1)

    by_doc = np.searchsorted(start, offsets)
    word_bytes = per_text(~space, bounds)
    lost = per_text(np.where(failed, word_bytes, 0), by_doc)
    whole = per_text(word_bytes, by_doc)
    total = words.count.astype(np.int64)
    again = per_text(repeated, words.first)
    base_failed = (total < rules.min_words) | (100 * again > rules.max_repeat_percent * total)
    columns = {
        "n_words": total,
        "word_chars": per_text(~space & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(symbol, offsets),
        "n_dup_lines": per_text(before, by_doc),
        "n_repeat_words": again,
        "base_failed": base_failed,
        "kept": ~base_failed & (lost <= rules.max_lost * whole),
        "n_failed_lines": per_text(failed, by_doc),
        "lost_bytes": lost,
    }
    assert all(len(v) == n_docs for v in columns.values())
    return columns, start, end, failed


def _clean(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, failed: np.ndarray, trim: np.ndarray) -> list[str]:
    keep = np.ones(len(data) + 1, np.int8)
    gone = np.zeros(len(data) + 1, np.int64)
    np.add.at(gone, start[failed], 1)
    np.add.at(gone, end[failed], -1)
    keep = np.cumsum(gone[:-1]) == 0
    out = []
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        text = data[a:b] if not trim[i] else data[a:b][keep[a:b]]
        shown = text.tobytes().decode("utf-8")
        out.append(shown.removesuffix("\n") if trim[i] and b > a and data[b - 1] != 10 else shown)
    return out


_KINDS = {"base_failed": pa.bool_(), "kept": pa.bool_()}


def apply_rules(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text", key: str = "doc_id", with_text: bool = True) -> DataFrame:
    """Per row: key, counts, base_failed, kept and (with_text) cleaned: the text without its failing lines.

    Null text: no words, so base_failed.  Empty texts likewise.  Repeated rows each get a result; other columns are
    ignored.  One narrow stage; a worker holds one slice of texts, and a very long text stands alone.
    """
    ship(docs.sparkSession)
    docs = docs.select(key, text)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_bytes"]

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for a, b in slices(offsets):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                columns, start, end, failed = judge(part, own, rules)
                arrays = [batch.column(key).slice(a, b - a), *[pa.array(columns[n], _KINDS.get(n, pa.int64())) for n in names]]
                if with_text:
                    arrays.append(pa.array(_clean(part, own, start, end, failed, columns["n_failed_lines"] > 0), pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, [key, *names, *["cleaned"] * with_text])

    kinds = ", ".join(f"{n} {'boolean' if n in _KINDS else 'long'}" for n in names)
    return docs.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {kinds}" + ", cleaned string" * with_text)


def filter_documents(docs: DataFrame, rules: LineRules = LineRules(), text: str = "text", length: str = "n_chars") -> DataFrame:
    """The kept rows with all their columns: text without its failing lines, and length (if there is one) to match."""
    ship(docs.sparkSession)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            for a, b in slices(offsets):
                part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                columns, start, end, failed = judge(part, own, rules)
                cleaned = pa.array(_clean(part, own, start, end, failed, columns["n_failed_lines"] > 0), pa.string())
                rows = batch.slice(a, b - a)
                arrays = [cleaned if n == text else pc.cast(pc.utf8_length(cleaned), rows.column(n).type) if n == length else rows.column(n) for n in rows.schema.names]
                yield pa.RecordBatch.from_arrays(arrays, rows.schema.names).filter(pa.array(columns["kept"]))

    return docs.mapInArrow(run, schema)
