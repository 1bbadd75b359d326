"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected.

The rules of a line (all over the bytes of the whole text, no pattern engine):

* punctuation: a third or more of its words come with a symbol of `#*$%&|<>`, or a third with an exclamation mark;
* shouting: nearly all its ASCII letters are capitals, in five words or more;
* navigation: two or more `|` separators, at least one in six words; or two links or more, at least one in two words; or
  one of four or more labels in a row (blank lines aside) that show themselves as a menu: half of them stand in the text
  again or hold a link, or they stand at the text's beginning or end and hold a third of its words at most. A label is a
  line of three words and 30 characters at most without an end mark, of any script, before its closing quotes and brackets;
* repetition: ten words or more of which few are different;
* boilerplate: a short line that holds a fixed phrase of site furniture.

Each text is judged by itself, whatever stands beside it in its slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

# Phrases of site furniture in four languages, A-Z in lower case.
BOILERPLATE = tuple(
    phrase.encode()
    for phrase in (
        "all rights reserved",
        "accept cookies",
        "accept all cookies",
        "we use cookies",
        "uses cookies",
        "cookie policy",
        "cookie settings",
        "enable javascript",
        "javascript is disabled",
        "privacy policy",
        "terms of service",
        "terms of use",
        "terms and conditions",
        "subscribe to our newsletter",
        "sign up for our newsletter",
        "click here to",
        "read more",
        "skip to content",
        "back to top",
        "log in to comment",
        "leave a comment",
        "share on facebook",
        "share on twitter",
        "follow us on",
        "powered by wordpress",
        "lorem ipsum",
        "alle rechte vorbehalten",
        "diese website verwendet cookies",
        "zum inhalt springen",
        "newsletter abonnieren",
        "allgemeine geschäftsbedingungen",
        "tous droits réservés",
        "politique de confidentialité",
        "mentions légales",
        "ce site utilise des cookies",
        "aller au contenu",
        "todos los derechos reservados",
        "política de privacidad",
        "este sitio utiliza cookies",
        "aviso legal",
        "saltar al contenido",
    )
)
#: Last characters of a line that is a sentence, or part of one, and what may close it after them. Fixed values.
END_MARKS = ".!?:;,…—–。！？：；，、．｡､؟؛،۔।॥։።၊။"
CLOSERS = "\"'”’»›“‘„‚«‹)]}）］｝〕」』】》〉"

_ASCII = np.arange(256)
_SYMBOL = np.isin(_ASCII, list(b"#*$%&|<>"))
_UPPER = (_ASCII >= 0x41) & (_ASCII <= 0x5A)
_LOWER = (_ASCII >= 0x61) & (_ASCII <= 0x7A)
_POINT = (_ASCII & 0xC0) != 0x80  # the first byte of a code point


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules; max_loss is the share of a document's words that may go with failing lines."""

    symbols_per_word: float = 1 / 3
    shouts_per_word: float = 1 / 3
    capitals: float = 0.8
    separators_per_word: float = 1 / 6
    links_per_word: float = 1 / 2
    menu_words: int = 3
    menu_chars: int = 30
    menu_lines: int = 4
    menu_share: float = 1 / 3
    distinct: float = 0.34
    boilerplate_words: int = 20
    min_words: int = 50
    max_repeat: float = 0.5
    max_loss: float = 0.3


def _counts(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the lines of all texts, and the number of each text's first line (n+1)."""
    n = len(data)
    cut = np.flatnonzero(data == 0x0A)
    starts = np.union1d(cut + 1, offsets[:-1])
    starts = starts[starts < n]
    ends = np.empty(len(starts), np.int64)
    ends[:-1] = starts[1:]
    if len(ends):
        ends[-1] = n
    ends -= data[ends - 1] == 0x0A
    return starts, ends, np.searchsorted(starts, offsets)


def _finds(text: bytes, phrase: bytes, line_starts: np.ndarray, line_ends: np.ndarray) -> np.ndarray:
    """The lines that hold a phrase whole, once for each place; a find that runs from one text into the next is none."""
    places, at = [], text.find(phrase)
    while at >= 0:
        places.append(at)
        at = text.find(phrase, at + 1)
    places = np.array(places, np.int64)
    lines = np.searchsorted(line_starts, places, side="right") - 1
    return lines[places + len(phrase) <= line_ends[lines]]


def _last_points(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code point before each end, and the byte where it begins."""
    at = ends - 1
    for _ in range(3):
        at = at - ((data[at] & 0xC0) == 0x80)
    lead = data[at].astype(np.int64)
    point = np.where(lead < 0x80, lead, np.where(lead < 0xE0, lead & 0x1F, np.where(lead < 0xF0, lead & 0x0F, lead & 0x07)))
    for j in range(1, 4):
        more = at + j < ends
        point = np.where(more, point << 6 | data[np.minimum(at + j, len(data) - 1)] & 0x3F, point)
    return point, at


def _unended(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words that hold something before their closing quotes and brackets and don't end with an end mark there."""
    marks, closers = (np.array([ord(c) for c in x]) for x in (END_MARKS, CLOSERS))
    ends, out, left = ends.copy(), np.zeros(len(starts), bool), np.arange(len(starts))
    while len(left):
        point, at = _last_points(data, ends[left])
        closing = np.isin(point, closers)
        out[left[~closing]] = ~np.isin(point[~closing], marks)
        ends[left] = at
        left = left[closing & (at > starts[left])]
    return out


def judge(data: np.ndarray, offsets: np.ndarray, rules: LineRules) -> dict[str, np.ndarray]:
    """Counts, verdicts and failing lines of the texts of one slice."""
    docs = len(offsets) - 1
    starts, ends, first = W.spans(data, offsets)
    n_words = np.diff(first)
    doc_of = np.repeat(np.arange(docs), n_words)
    hashes = W.span_hashes(data, starts, ends)
    points = np.bincount(doc_of, _counts(_POINT[data], starts, ends), docs).astype(np.int64)
    symbols = _SYMBOL[data]

    # windows of three words that a text holds twice or more
    at = W.window_starts(first, 3)
    grams = W.window_hashes(hashes, 3)[at] ^ W.mix(doc_of[at].astype(np.uint64) + np.uint64(1))
    _, back, times = np.unique(grams, return_inverse=True, return_counts=True)
    again = at[times[back] > 1] if len(at) else at
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + 3, -1)
    repeated = np.bincount(doc_of, np.cumsum(edge)[:-1] > 0, docs).astype(np.int64)

    ls, le, lfirst = _lines(data, offsets)
    line_doc = np.repeat(np.arange(docs), np.diff(lfirst))
    line_of = np.searchsorted(ls, starts, side="right") - 1  # of each word
    lwords = np.bincount(line_of, minlength=len(ls))
    full = np.flatnonzero(lwords > 0)
    lhash = W.span_hashes(data, ls[full], le[full]) ^ W.mix(line_doc[full].astype(np.uint64) + np.uint64(1))
    _, once = np.unique(lhash, return_index=True)
    dup_lines = (np.bincount(line_doc[full], minlength=docs) - np.bincount(line_doc[full][once], minlength=docs)).astype(np.int64)

    pairs = np.unique(W.mix(hashes) ^ W.mix(line_of.astype(np.uint64) + np.uint64(1)), return_index=True)[1]
    distinct = np.bincount(line_of[pairs], minlength=len(ls))
    words = np.maximum(lwords, 1)
    lsymbols, shouts, bars = _counts(symbols, ls, le), _counts(data == 0x21, ls, le), _counts(data == 0x7C, ls, le)
    upper, lower = _counts(_UPPER[data], ls, le), _counts(_LOWER[data], ls, le)
    fails = (lsymbols >= 2) & (lsymbols >= rules.symbols_per_word * words)
    fails |= (shouts >= 3) & (shouts >= rules.shouts_per_word * words)
    fails |= (lwords >= 5) & (upper >= rules.capitals * (upper + lower)) & (upper >= 10)
    fails |= (bars >= 2) & (bars >= rules.separators_per_word * words)
    fails |= (lwords >= 10) & (distinct <= rules.distinct * lwords)
    links = np.bincount(_finds(data.tobytes(), b"://", ls, le), minlength=len(ls))
    fails |= (links >= 2) & (links >= rules.links_per_word * words)
    if len(full):
        final = np.cumsum(lwords)[full] - 1  # the last word of each line with words
        lpoints = np.bincount(line_of, _counts(_POINT[data], starts, ends), len(ls))
        short = (lwords[full] <= rules.menu_words) & (lpoints[full] <= rules.menu_chars)
        short[short] = _unended(data, starts[final[short]], ends[final[short]])
        _, same, times = np.unique(lhash, return_inverse=True, return_counts=True)
        shown = (times[same] > 1) | (links[full] > 0)
        fdoc = line_doc[full]
        turn = fdoc[1:] != fdoc[:-1]
        edge_line = np.concatenate([[True], turn]) | np.concatenate([turn, [True]])
        new = np.concatenate([[True], (short[1:] != short[:-1]) | turn])
        head, run = np.flatnonzero(new), np.cumsum(new) - 1
        size, total = np.diff(head, append=len(full)), np.add.reduceat(lwords[full], head)
        menu = 2 * np.add.reduceat(shown.astype(np.int64), head) >= size
        menu |= np.logical_or.reduceat(edge_line, head) & (total <= rules.menu_share * n_words[fdoc[head]])
        fails[full[short & (menu & (size >= rules.menu_lines))[run]]] = True
    text = W.lowered(data).tobytes()
    for phrase in BOILERPLATE:
        line = _finds(text, phrase, ls, le)
        fails[line[lwords[line] <= rules.boilerplate_words]] = True
    lost = np.bincount(line_doc, np.where(fails, lwords, 0), docs).astype(np.int64)
    base_failed = (n_words < rules.min_words) | (repeated > rules.max_repeat * n_words)
    return {
        "n_words": n_words, "word_chars": points, "n_symbols": _counts(symbols, offsets[:-1], offsets[1:]), "n_dup_lines": dup_lines, "n_repeat_words": repeated, "base_failed": base_failed,
        "kept": ~base_failed & (lost <= rules.max_loss * n_words), "n_words_lost": lost, "fails": fails, "line_starts": ls, "line_ends": le, "first_line": lfirst,
    }


def quality_rules(docs: DataFrame, rules: LineRules | None = None, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_words_lost, n_lines_failed; with_text adds clean_text, the text without its failing lines.

    Null and empty texts have no words: all counts are 0 and they fail (too few words). Very long texts are
    judged whole. Repeated rows are judged alike; an empty table gives an empty result; further columns of
    docs are ignored. A map over the rows: no shuffle, memory bounded by a slice of texts.
    """
    rules = rules or LineRules()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, kept boolean, n_words_lost long, n_lines_failed long" + ", clean_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch):
                data, offsets = W.packed(part.column("text"))
                got = judge(data, offsets, rules)
                first = got["first_line"]
                total = np.concatenate([[0], np.cumsum(got["fails"])])
                columns = [part.column("doc_id"), *(pa.array(got[x].astype(np.int64)) for x in names), pa.array(got["base_failed"]), pa.array(got["kept"]), pa.array(got["n_words_lost"]), pa.array(total[first[1:]] - total[first[:-1]])]
                if with_text:
                    raw, ls, le, fails = data.tobytes(), got["line_starts"], got["line_ends"], got["fails"]
                    columns.append(pa.array([b"\n".join(raw[ls[i] : le[i]] for i in range(first[d], first[d + 1]) if not fails[i]).decode("utf-8", "replace") for d in range(part.num_rows)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, "base_failed", "kept", "n_words_lost", "n_lines_failed", *["clean_text"] * with_text])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
