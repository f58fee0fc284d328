"""Sentence boundaries in texts of many languages and scripts.

Whether a period ends a sentence is settled by what the text itself shows (its casing, its quotes
and brackets, words it uses with and without a period, words it capitalises inside sentences or
writes in lower case), then, where these show nothing, by the same evidence over the whole corpus
and by a short list whose words count only in their usual place (a number after ``no.``, a name
after ``Dr.``). Scripts with their own end marks or with spaces as boundaries have rules of their
own.

The corpus evidence is one aggregate over all documents. It comes to the texts by a join on the
words each holds, so nothing is left out for the size of the corpus or its vocabulary.

Fixed bounds: an abbreviation has at most ``LONGEST`` characters, a word is read over its last 24,
quotes and brackets are matched over the innermost ``_DEPTH`` that are open.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import spread

#: Share of the usual width that wrapped lines reach.
_RAGGED = 0.8
#: Share of capitals within sentences from which on they mark nouns of all kinds, not names.
_NOUNS = 0.2
#: Least occurrences with a period.
SEEN = 8
#: Longest abbreviation, in characters.
LONGEST = 8

#: Open quotes and brackets that a closing one is matched with.
_DEPTH = 8

# Abbreviations known without evidence, by the place in which their period ends no sentence.
ANYWHERE = "vs cf approx aprox incl e.g i.e"
BEFORE_NUMBER = "no nr ref fig ver vol sec p pág ca env rs tue mon wed thu fri sat sun रु ரூ"
BEFORE_NAME = "dr prof mr mrs ms st sr sra lt pvt डॉ திரு ডা"
# Abbreviations that may end a sentence or stand inside one.
MAY = "etc usw p.m a.m ltd inc co u.k u.s"
# Month names after a day number with a period.
MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"
# Words that carry a sentence on after a quotation or bracket, where no casing tells.
CARRY_ON = "and or but nor in on at to of for from with by asked said says wrote replied sagte fragte und dit dijo y"

# End marks that need no space: CJK, Indic, Arabic, Armenian, Ethiopic, Khmer, Burmese, Tibetan.
_END, _OWN_END = ".!?…", "。！？｡।॥۔؟։።፧។៕။།༎"
_CLOSERS = "\"'”’»)]}）」』》】›"
_OPENERS = "\"'“‘«„([{（「『《【‹¿¡"
_PAIRS = {"“": "”", "«": "»", "(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "《": "》"}
_BRACKETS = "([（"
# Japanese and Chinese signs and particles that carry a sentence on after a quotation.
_QUOTED_ON = ("，", "、", ",", ";", "と", "的", "って", "という", "を", "の")
_WORD_EDGES = frozenset(_OPENERS + "）。，、/- \n\t")
_QUOTING = {*_PAIRS, *_PAIRS.values(), "„", "‘", "’", '"'}
_MARKS = re.compile(rf"[{re.escape(_END + _OWN_END)}|]+|(?<=[\u0370-\u03ff\u1f00-\u1fff])[;\u037e]")  # the Greek question mark looks like a semicolon
_LIST_MARK = re.compile(r"(?:\d{1,3}[.)]|[a-z][.)]|[-*•‣–])[ \t]+(?=\S)")
_LABEL = re.compile(r"[A-Z][A-Za-z]{0,14}:[ \t]")
_LEAD = re.compile(rf"^(?:{_LIST_MARK.pattern}|{_LABEL.pattern}|(?:[-*•‣–]|\d{{1,3}}[.)]|[a-z][.)])[ \t]*$)")
_LOG = re.compile(r"\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\{\"|[ \t]+at [\w.$]+\(")
_LINE = re.compile(r"[^\r\n\u2028\u2029\x85]*(?:\r\n|[\r\n\u2028\u2029\x85]|$)")
_THAI = re.compile("[\u0e00-\u0e7f]")
_UNITS = r"(?:[kKMGTmcµ]?(?:B|b|bps|m|g|s|l|W|V|A|Hz)|%|h|min)"  # after a number
_CLAUSE_END = re.compile(f"(?:(?<=[\u0e00-\u0e7f])|\\d ?{_UNITS})[ \u00a0]+")
_UNIT = re.compile(f"{_UNITS}$")
_THREE = re.compile(r"[^\S\r\n]*(\S+)[^\S\r\n]+(\S+)[^\S\r\n]+(\S+)")
_TOKEN = re.compile(r"\s*(\S+)")
_DOTTED = re.compile(r"(?<!\S)[\"'“‘«„(\[（]*(\S{0,7}[^\W\d_])([.!])[\"'”’»)\]]*(?=\s+[\"'“‘«„(\[¿¡]*(\S))")
_FINAL = re.compile(r"(?<!\S)[\"'“‘«„(\[（]*(\S{0,7}[^\W\d_])\.[\"'”’»)\]]*[ \t]*(?:\n[ \t]*\n|\n?\Z)")
_STARTS = re.compile(r"([.!?]+)[ ]+([^\W\d_])(\w*)")
_INSIDE = re.compile(r"\.(?:[,;:](?=\s)|[ \u00a0]+(?=([^\W\d_A-Z]\w*)))")
_WORD = re.compile(r"[\w’'-]*")
_MONTH = re.compile(rf"(?:{MONTHS.replace(' ', '|')})\b")


def _case(char: str) -> str:
    """l lower, u upper, d digit, o letter without case, x other."""
    if char.isdigit():
        return "d"
    if char.isalpha():
        return "l" if char.islower() else "u" if char.isupper() else "o"
    return "x"


def _cjk(char: str) -> bool:
    return "\u3040" <= char <= "\u30ff" or "\u3400" <= char <= "\u9fff" or "\uac00" <= char <= "\ud7af"


# --- corpus evidence ------------------------------------------------------------------------


def count_words(texts: list[str]) -> list[tuple]:
    """(word, then its uses: plain, dotted, dotted before lower, upper, digit, caseless, banged, banged before lower, dotted at the end of a paragraph)."""
    plain: Counter[str] = Counter()
    dotted: Counter[tuple[str, str, str]] = Counter()
    for token, n in Counter(w for t in texts for w in t.split()).items():
        bare = token.strip(_OPENERS + _CLOSERS + ",;:")
        if bare and len(bare) <= LONGEST and bare[-1].isalpha():
            plain[bare.casefold()] += n
    for text in texts:
        for word, mark, following in _DOTTED.findall(text):
            if len(word) <= LONGEST:
                dotted[word.casefold(), mark, _case(following)] += 1
    final = Counter(w.casefold() for t in texts for w in _FINAL.findall(t) if len(w) <= LONGEST)
    rows = {w: [0] * 9 for w in {w for w, _, _ in dotted} | {*final}}
    for (word, mark, case), n in dotted.items():
        row = rows[word]
        if mark == ".":
            row[1] += n
            if case in "ludo":
                row[2 + "ludo".index(case)] += n
        else:
            row[6] += n
            row[7] += n * (case == "l")
    for word, row in rows.items():
        row[0], row[8] = plain[word], final[word]
    # words never dotted here may be elsewhere: their plain uses count as well
    return [(w, *r) for w, r in rows.items()] + [(w, n, *[0] * 8) for w, n in plain.items() if w not in rows]


_COUNTS = ["plain", "dotted", "lower", "upper", "digit", "caseless", "banged", "banged_lower", "final"]


#: A word before a period or an exclamation mark in a token: with the periods inside it and without.
_CANDIDATES = [re.compile(rf"""([^\s"'“‘«„(\[（。，、/\-{inner}]{{2,24}})[.!]""") for inner in ("", ".")]


def marked_words(text: str) -> set[str]:
    """The words of a text that stand before a period or an exclamation mark, case-folded."""
    marked = " ".join({w for w in text.split() if "." in w or "!" in w})
    return {w.casefold() for c in _CANDIDATES for w in c.findall(marked)}


def corpus_evidence(documents: DataFrame, seen: int = SEEN) -> DataFrame:
    """(word, kind) over all texts: the period of a 'never' word ends no sentence, that of a 'number' word none before a number; 'bang' marks names written with '!'.

    A word needs ``seen`` uses with its mark to count, whatever the size of the corpus.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = count_words([t for t in batch.column(0).to_pylist() if t])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows)], ["word", *_COUNTS])

    schema = "word string, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    words = spread(documents.select("text").filter("text IS NOT NULL")).mapInArrow(counts, schema)
    totals = words.groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS]).filter("dotted > 0 OR banged > 0")
    inner = F.col("final") <= 0.02 * (F.col("dotted") + F.col("final"))  # a paragraph's last word is no title
    always = F.col("plain") <= 0.05 * F.col("dotted")
    one_way = F.greatest(F.col("lower") + F.col("digit"), "upper", "caseless") >= 0.97 * F.col("dotted")
    short = (F.length("word") <= 6) | F.col("word").contains(".")
    kind = (
        F.when((F.col("banged_lower") >= 0.9 * F.col("banged")) & (F.col("banged") >= seen) & (F.col("plain") <= 0.1 * F.col("banged")), "bang")
        .when(always & short & (F.col("dotted") >= seen) & one_way & inner, "never")
        .when((F.col("digit") >= 0.9 * F.col("dotted")) & (F.col("dotted") >= seen) & inner, "number")
    )
    return totals.select("word", kind.alias("kind")).filter("kind IS NOT NULL AND length(word) > 1")


def _with_evidence(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """``texts`` with ``known``: the evidence on the words each holds, as "word<tab>kind". Copies of a text share it."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [marked_words(t) for t in batch.column(1).to_pylist()]
            rows = np.repeat(np.arange(len(found)), np.array([len(w) for w in found], np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([w for f in found for w in f], pa.string())], ["_key", "word"])

    keyed = texts.withColumn("_key", F.xxhash64("text"))
    found = keyed.select("_key", "text").mapInArrow(words, "_key bigint, word string").join(evidence, "word")
    known = found.groupBy("_key").agg(F.collect_set(F.concat_ws("\t", "word", "kind")).alias("known"))
    return keyed.join(known, "_key", "left").drop("_key")


# --- one text -------------------------------------------------------------------------------


class _Text:
    """What one text shows about itself, and its sentence ends."""

    def __init__(self, text: str, corpus: dict[str, str]) -> None:
        self.text, self.corpus = text, corpus
        self.anywhere, self.number, self.name, self.may = (set(w.split()) for w in (ANYWHERE, BEFORE_NUMBER, BEFORE_NAME, MAY))
        self.carry = set(CARRY_ON.split())
        self.inside: Counter[str] = Counter()
        self.months = _MONTH
        self.careless = False
        first = re.match(r"\W*([^\W\d_])(\w*)", text)
        low_start = bool(first) and first[1].islower() and not any(c.isupper() for c in first[2])
        low = cased = 0
        for m in _STARTS.finditer(text):
            at = m.start() - (text[m.start() - 1 : m.start()] in (" ", "\u00a0"))
            if not (text[at - 1 : at].isdigit() or (at > 2 and text[at - 3 : at].isalpha())):
                continue
            word = self._word(at)
            if _case(m[2]) not in "lu" or self._known(word, m.end(1)) or self.corpus.get(word.casefold()) == "bang":
                continue
            if m[1].startswith("..") and text[: at - len(word)].rstrip(_OPENERS + " \n")[-1:] in {"", *_END}:
                continue  # an interjection: "Well... it is"
            cased += 1
            low += m[2].islower() and not any(c.isupper() for c in m[3])
        #: Sentences begin in lower case here: casing tells nothing.
        self.careless = low > 0 and low >= (0.3 if low_start else 0.5) * cased
        #: Words with a period that the sentence plainly goes on after: how often.
        self.inside = Counter(self._insides())
        self.thai = bool(_THAI.search(text))

    @cached_property
    def listed(self) -> bool:
        """Lines that open with a mark are items of a list here, not wrapped text that begins with a number."""
        lines = [line for line in self.text.split("\n") if line.strip()]
        marked = sum(1 for line in lines if _LIST_MARK.match(line.lstrip()))
        return marked >= 2 and marked >= 0.3 * len(lines)

    def _word(self, end: int, begin: int = 0) -> str:
        """The word that ends at ``end``, not reaching before ``begin``."""
        start, text = end, self.text
        least = max(begin, end - 24)
        while start > least and text[start - 1] not in _WORD_EDGES and not text[start - 1].isspace():
            start -= 1
        return text[start:end]

    def _insides(self) -> Iterator[str]:
        """Each word before a period that a comma or, where casing tells, a word in lower case follows."""
        for m in _INSIDE.finditer(self.text):
            if m[1] and (self.careless or not m[1][0].islower() or any(c.isupper() for c in m[1])):
                continue
            word = self._word(m.start())
            if len(word) > 1 and not any(c.isdigit() for c in word):
                yield word.casefold()

    @cached_property
    def _uses(self) -> tuple[Counter[str], Counter[str], Counter[str], Counter[str], bool]:
        """Words in uses that leave no doubt: without period (as written), capitalised inside a sentence and in lower case (both case-folded); all in lower case without period; whether all nouns are capitalised.

        A use without period counts where a word in lower case or a comma follows: before a capital or
        a number it may be an abbreviation written without its period.
        """
        plain: Counter[str] = Counter()
        named: Counter[str] = Counter()
        lower: Counter[str] = Counter()
        bare: Counter[str] = Counter()
        for line in self.text.split("\n"):
            tokens, inside = line.split(), False
            for token, after in zip(tokens, [*tokens[1:], ""]):
                word = token.strip(_OPENERS + _CLOSERS + ",;:!?…")
                if word and word[0].islower():
                    lower[word.rstrip(".").casefold()] += 1
                if word and word[-1] != ".":
                    if word[0].islower():
                        bare[word.casefold()] += 1
                    elif inside and token[0] == word[0] and word[0].isupper():
                        named[word.casefold()] += 1
                    if (inside or not word[0].isupper()) and (token[-1] in ",;" or (token[-1] == word[-1] and after and _case(after[0]) in "lo")):
                        plain[word] += 1
                inside = bool(word) and any(c.isalnum() for c in word) and token.rstrip(_CLOSERS)[-1:] not in _END + _OWN_END + ":|" and not _LIST_MARK.fullmatch(token + " ")
        capitals = sum(named.values())
        return plain, named, lower, bare, capitals > _NOUNS * (capitals + sum(lower.values()))

    def _own(self, word: str) -> str:
        """'word' or 'abbreviation' as the other uses in this text show, '' where they show nothing or both."""
        inside = self.inside[word.casefold()]
        if self._uses[0][word]:
            return "" if inside else "word"
        if not inside or self._uses[3][word.casefold()]:
            return ""
        return "abbreviation" if len(word) <= 3 or inside > 1 else ""  # a longer word once: rather a slip in casing

    def _next(self, word: str) -> str:
        """'name' or 'common' as the other uses of a capitalised word in this text show, '' where they show nothing or both."""
        _, named, lower, _, nouns = self._uses
        key = word.casefold()
        if len(word) < 2 or bool(named[key]) == bool(lower[key]):
            return ""
        return "common" if lower[key] else "" if nouns else "name"

    def _abbreviation(self, word: str, after: int) -> str:
        """'never', 'may', 'own' (shown by this text alone) or '' for an ordinary word before ``after``; the text decides before corpus and lists."""
        known = self._known(word, after)
        if not known and not self.inside[word.casefold()]:
            return ""
        own = self._own(word)
        return "" if own == "word" else known or ("own" if own else "")

    def _known(self, word: str, after: int) -> str:
        """'never', 'may' or '' by corpus, lists and form, and by what stands from ``after`` on."""
        key = word.casefold()
        shown = self.corpus.get(key)
        if shown == "never" or key in self.anywhere:
            return "never"
        if shown == "number" or key in self.number:
            token = _TOKEN.match(self.text, after)
            return "never" if token and any(c.isdigit() for c in token[1]) else ""
        if key in self.name:
            if word[:1].islower() and not self.careless:
                return ""
            return "never"
        if key in self.may:
            return "may"
        return "may" if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word) else ""

    def spans(self, kind: str | None) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for start, end in self._units(kind == "log"):
            if kind == "log" or _LOG.match(self.text, start, end):
                out.append((start, end))
            else:
                out += self._sentences(start, end)
        return self._trimmed(out)

    def _trimmed(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out = []
        for a, b in spans:
            while a < b and self.text[a].isspace():
                a += 1
            while a < b and self.text[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
        return out

    def _units(self, log: bool) -> Iterator[tuple[int, int]]:
        """Stretches that no sentence crosses: lines, joined where a sentence plainly runs on."""
        text = self.text
        lines = [(m.start(), m.start() + len(m[0].rstrip("\r\n\u2028\u2029\x85"))) for m in _LINE.finditer(text) if m.end() > m.start()]
        widths = [len(text[a:b].rstrip()) for a, b in lines]
        broken = sorted(w for w, after in zip(widths, [*widths[1:], 0]) if w and after)
        width = broken[len(broken) // 2] if broken else 0  # of lines that another line follows
        start = None
        for i, (a, b) in enumerate(lines):
            if not text[a:b].strip():
                if start is not None:
                    yield start, lines[i - 1][1]
                start = None
                continue
            if start is None:
                start = a
            elif log or not self._runs_on(lines[i - 1], (a, b), width):
                yield start, lines[i - 1][1]
                start = a
        if start is not None:
            last = max(i for i, w in enumerate(widths) if w)
            yield start, lines[last][1]

    def _runs_on(self, before: tuple[int, int], line: tuple[int, int], width: int) -> bool:
        text = self.text
        this, previous = text[line[0] : line[1]], text[before[0] : before[1]].rstrip()
        if _LOG.match(this) or _LOG.match(previous):
            return False
        bare = this.lstrip()
        word = bare.split(maxsplit=1)[0]
        wrapped = 24 <= width <= 120 and len(previous) >= _RAGGED * width
        if _LABEL.match(bare):
            return False
        last = self._word(before[0] + len(text[before[0] : before[1]].rstrip()) - 1, before[0])
        ended = previous[-1] in _END + _OWN_END and len(last) != 1 and not self._abbreviation(last, line[0])
        if _LIST_MARK.match(bare) and (self.listed or not wrapped or ended):
            return False
        return wrapped or (_case(word[0]) == "l" and not self.careless and previous[-1:] not in _END + _OWN_END)

    def _pairs(self, start: int, end: int) -> dict[int, int]:
        """{opening: closing} of quotes and brackets within start:end, outermost only; what never closes counts for nothing."""
        text, found, stack = self.text, [], []
        for i in range(start, end):
            c = text[i]
            if c not in _QUOTING:
                continue
            if c == "’" and 0 < i < end - 1 and text[i - 1].isalpha() and text[i + 1].isalpha():
                continue  # an apostrophe
            depth = next((k for k in range(1, min(len(stack), _DEPTH) + 1) if stack[-k][0] == c), 0)
            if depth:
                found.append((stack[-depth][1], i))
                del stack[-depth:]
            elif c in _PAIRS:
                stack.append((_PAIRS[c], i))
            elif c == "„":
                stack.append(("“" if "“" in text[i + 1 : end] else "”", i))
            elif c == "‘":
                stack.append(("’", i))
            elif c == '"':
                stack.append(('"', i))
        out: dict[int, int] = {}
        reach = -1
        for opened, closed in sorted(found):
            if opened > reach:
                out[opened], reach = closed, closed
        return out

    def _sentences(self, start: int, end: int) -> list[tuple[int, int]]:
        text = self.text
        bare = start
        while bare < end and text[bare].isspace():
            bare += 1
        mark = _LIST_MARK.match(text, bare, end)
        begin, at = bare, mark.end() if mark else bare
        pairs = self._pairs(at, end)
        opened = {b: a for a, b in pairs.items()}
        out = []
        inside = sorted(pairs.items())
        k = 0
        while at < end:
            m = _MARKS.search(text, at, end)
            thai = self._thai_break(begin, at, m.start() if m else end)
            if thai:
                out.append((begin, thai))
                begin = at = thai
                continue
            if not m:
                break
            while k < len(inside) and inside[k][1] < m.start():
                k += 1
            if k < len(inside) and inside[k][0] < m.start() < inside[k][1]:
                close = inside[k][1]
                stop = self._after_closing(begin, opened[close], close, end)
                if stop is None:
                    at = close + 1
                    continue
            else:
                stop = self._ends(begin, m.start(), m.end(), end)
                if stop is None:
                    at = m.end()
                    continue
            out.append((begin, stop))
            begin = at = stop
        if text[begin:end].strip():
            out.append((begin, end))
        return out

    def _thai_break(self, begin: int, start: int, stop: int) -> int | None:
        """A space after a Thai clause, or after its unit, unless a number and its unit follow."""
        text = self.text
        if not self.thai or not _THAI.search(text, begin, stop):
            return None
        for m in _CLAUSE_END.finditer(text, start, stop):
            if m.end() <= begin:
                continue
            if _THAI.match(text, m.end()):
                return m.end()
            three = _THREE.match(text, m.end())
            words = [w.strip(_OPENERS + _CLOSERS + ",.;:!?…") for w in three.groups()] if three else []
            if words and not _THAI.search("".join(words)) and not _UNIT.match(words[1]) and sum(any(c.isalpha() for c in w) for w in words) >= 2:
                return m.end()  # a sentence of another language
        return None

    def _absorb(self, at: int, end: int) -> int:
        """Past closing quotes and brackets and repeated or detached end marks."""
        text = self.text
        while at < end:
            if text[at] in _END + _OWN_END or (text[at] in _CLOSERS and text[at] not in "\"'"):
                at += 1
                continue
            if text[at] in "\"'" and (at + 1 >= end or text[at + 1].isspace() or text[at + 1] in _END + _OWN_END + _CLOSERS):
                at += 1
                continue
            gap = at
            while gap < end and text[gap] in " \t\u00a0\u202f":
                gap += 1
            after = gap
            while after < end and text[after] in _END + _OWN_END:
                after += 1
            if gap > at and after > gap and (after >= end or text[after].isspace() or text[after] in _CLOSERS):
                at = after
                continue
            break
        return at

    def _following(self, at: int, end: int) -> tuple[str, str, str]:
        """(case of the next letter or sign past opening quotes, its word, whether an opener came first)."""
        text, opener = self.text, ""
        while at < end and (text[at].isspace() or text[at] in _OPENERS):
            if text[at] in _OPENERS:
                opener = text[at]
            at += 1
        if at >= end:
            return "", "", opener
        word = _WORD.match(text, at)[0]
        case = _case(text[at])
        if case == "l" and any(c.isupper() for c in word[1:4]):
            case = "u"  # eSIM, myBrand: a name
        return case, word, opener

    def _after_closing(self, begin: int, opened: int, close: int, end: int) -> int | None:
        """The end of the sentence at a closing quote or bracket with an end mark before it."""
        text = self.text
        if text[opened] in _BRACKETS and _LEAD.sub("", text[begin:opened].lstrip()).strip():
            return None  # a bracket inside a sentence
        inner = close - 1
        while inner > opened and text[inner].isspace():
            inner -= 1
        if text[inner] not in _END + _OWN_END:
            return None
        stop = self._absorb(close + 1, end)
        if stop >= end:
            return end
        if stop > close + 1 and text[stop - 1] in _END + _OWN_END:
            return stop
        nearest = text[stop]
        if _cjk(text[inner - 1]) or text[inner] in _OWN_END:
            if text.startswith(_QUOTED_ON, stop):
                return None
            if _cjk(nearest) or not nearest.isspace():
                return stop
        if not nearest.isspace():
            return None
        case, word, _ = self._following(stop, end)
        if case == "l":
            return stop if self.careless and word.casefold() not in self.carry else None
        return None if nearest in ",;" else stop

    def _ends(self, begin: int, first: int, last: int, end: int) -> int | None:
        """The end of the sentence whose end mark stands at first:last, or None if none ends there."""
        text = self.text
        marks = text[first:last]
        stop = self._absorb(last, end)
        if "|" in marks:
            before = text[:first].rstrip()[-1:]
            if marks == "|" and before and "\u0900" <= before <= "\u0dff":
                return stop
            return None
        if any(c in _OWN_END for c in marks) or marks in ";\u037e":
            return stop
        if stop >= end:
            return end
        nearest = text[stop]
        previous = text[first - 1] if first > begin else ""
        if set(marks) <= {"…"} and (_cjk(previous) or _cjk(nearest) or nearest.isalnum()):
            return None
        ellipsis = marks.startswith("..") or "…" in marks
        dot = marks == "."
        word = self._word(first, begin)
        if not nearest.isspace():
            return stop if self._glued(word, previous, stop, end, dot) else None
        case, following, opener = self._following(stop, end)
        if ellipsis:
            if case == "l" and (not self.careless or not text[begin:first].strip(_OPENERS + " ").count(" ")):
                return None
            return stop
        if not dot:  # ! and ?
            if case == "l":
                if not self.careless or self.corpus.get(word.casefold()) == "bang":
                    return None
            return stop
        if word.isdigit():
            if len(word) <= 2 and (self.months.match(following) or case == "l") and not self.careless:
                return None
            return None if self.months.match(following) and len(word) <= 2 else stop
        if len(word) == 1 and word.isalpha():
            return self._initial(begin, first, word, case, following, stop)
        kind = self._abbreviation(word, stop)
        if case == "l":
            if kind:
                return stop if kind == "may" and self.careless else None
            return stop if self.careless or (len(word) >= 4 and not opener) else None  # a word, not an abbreviation
        if kind in ("never", "own"):  # a title stands before words of any kind
            return stop if case == "u" and word[:1].islower() and self._next(following) == "common" else None
        return stop

    def _initial(self, begin: int, first: int, word: str, case: str, following: str, stop: int) -> int | None:
        """A single letter and a period: an initial before what is a name elsewhere in the text, none before a common word; else unless it ends a name such as a plan's size."""
        before = self.text[begin : first - 1].split()
        if case == "u" and word.isupper() and len(before) > 1 and not before[-1].endswith(".") and (shown := self._next(following)):
            return stop if shown == "common" else None
        if word.islower() and before and before[-1][-1:].isdigit():
            return stop if case in "uo" else None  # a unit: "2.4 t"
        named = word.isupper() and len(before) > 1 and before[-1][:1].isupper() and not before[-1].endswith(".")
        if case == "l":
            return stop if named and self.careless else None
        return stop if named and case != "o" else None

    def _glued(self, word: str, previous: str, stop: int, end: int, dot: bool) -> bool:
        """Whether a sentence ends although no space follows."""
        text = self.text
        nearest, after = text[stop], text[stop + 1 : stop + 2]
        letters = len(word) >= 2 or previous in _CLOSERS
        if _cjk(nearest):
            return not _cjk(previous) or not dot
        if "@" in word or "/" in word or "www" in word:
            return False
        if nearest in "“‘«„¿¡(（「『" or (nearest == '"' and text[stop - 1] != '"'):
            return letters or not dot
        case = _case(nearest)
        if case == "u":
            return (letters and (after.islower() or not after.isalnum()) or not dot) and "." not in word
        if case == "o":
            return (letters and word[-2:].isalpha() and not self._abbreviation(word, stop)) or not dot
        return False


def sentence_spans(text: str | None, kind: str | None = None, corpus: dict[str, str] | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentences of one text, in order, trimmed of Unicode whitespace."""
    return _Text(text, corpus or {}).spans(kind) if text and not text.isspace() else []


def sentences(documents: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """(id, start, stop) of each sentence of each (id, text, kind).

    Positions are 0-based code points, the end exclusive, no whitespace at either end. Null, empty
    and blank texts give no row; so do rows of an empty table. ``kind`` 'log' makes every line a
    unit; it may be null. Copies are split alike. Other columns do not matter. ``evidence``: as
    ``corpus_evidence`` gives it; gathered from the texts themselves if absent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rows = zip(*(part.column(c).to_pylist() for c in (1, 2, 3)))
                spans = [sentence_spans(t, k, dict(w.split("\t") for w in known or ())) for t, k, known in rows]
                sizes = np.array([len(s) for s in spans], np.int64)
                flat = np.array([p for s in spans for p in s], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["id", "start", "stop"])

    rows = spread(documents.select("id", "text", "kind").filter("text IS NOT NULL"))
    known = _with_evidence(rows, corpus_evidence(documents) if evidence is None else evidence).select("id", "text", "kind", "known")
    return known.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, start bigint, stop bigint")
