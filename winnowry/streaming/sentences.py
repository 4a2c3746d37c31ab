"""Tokens to sentences: a splitter and a style-tag parser that read each character once, a batch operator and a streaming one over them."""
from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowry.functions.speech import DEFAULT_STYLE, LINE, STYLES, TAG

# Where a sentence ends, where it may be cut, and what must not be cut.
ENDINGS = "。！？!?；;\n…"
COMMAS = "，,、"
CLOSERS = {"(": ")", "（": "）", "[": "]", "【": "】", "{": "}", "｛": "｝", "<": ">", "「": "」", "『": "』"}
MAX_PREFIX = 48


@dataclass
class Place:
    """A place outside brackets and stars where the text may be parted: characters and visible characters up to it, since the turn began."""

    at: int
    seen: int
    soft: bool


class Splitter:
    """Parts a growing text: at an ending once the piece has ``least`` visible characters; beyond ``most`` characters at the
    last comma or space; beyond the hard limit at the nearest place outside brackets and stars. Never inside those.

    What is kept of a character is whether a piece may end after it, so nothing is read again when more text comes."""

    def __init__(self, most: int = 50, least: int = 4):
        if least < 1 or most < least:
            raise ValueError("limits must satisfy 1 <= least <= most")
        self.most, self.least, self.hard = most, least, most + max(10, most // 2)
        self.text, self.read, self.seen = "", 0, 0
        self.gone = Place(0, 0, False)  # what has been given out
        self.places: deque[Place] = deque()
        self.waiting: list[str] = []  # closers of the open brackets
        self.starred, self.last = False, ""

    def _take(self, c: str) -> bool:
        """Read a character; whether a sentence ends with it."""
        escaped, self.last = self.last == "\\", c
        self.read += 1
        self.seen += not c.isspace()
        if c == "*" and not escaped:
            self.starred = not self.starred
            opens = closes = True
        else:
            opens, closes = c in CLOSERS, bool(self.waiting) and c == self.waiting[-1]
            if opens:
                self.waiting.append(CLOSERS[c])
            elif closes:
                self.waiting.pop()
        if self.waiting or self.starred or (opens and c != "*"):
            return False
        bare = not (opens or closes)
        self.places.append(Place(self.read, self.seen, bare and (c in COMMAS or (c.isspace() and c not in ENDINGS))))
        return bare and c in ENDINGS and self.seen - self.gone.seen >= self.least

    def _overlong(self) -> Place | None:
        """Where to part a text beyond the limits that has no ending."""
        n, soft, within, beyond = self.read - self.gone.at, None, None, None
        if n <= self.most:
            return None
        for place in self.places:
            if place.at - self.gone.at > self.hard:
                beyond = place
                break
            within = place
            if place.soft and place.seen - self.gone.seen >= self.least:
                soft = place
        return soft or ((within or beyond) if n > self.hard else None)

    def _give(self, place: Place) -> Iterator[str]:
        piece, self.text = self.text[: place.at - self.gone.at], self.text[place.at - self.gone.at :]
        self.gone = place
        while self.places and self.places[0].at <= place.at:
            self.places.popleft()
        if piece.endswith("\\") and self.text.startswith("*"):  # the star isn't escaped any more
            rest, self.text = self.text, ""
            self.read, self.seen, self.waiting, self.starred, self.last = place.at, place.seen, [], False, ""
            self.places.clear()
            yield from (piece, *self.feed(rest)) if piece.strip() else self.feed(rest)
        elif piece.strip():
            yield piece
        if not self.text:
            self.last = ""

    def feed(self, token: str) -> list[str]:
        out: list[str] = []
        begin = 0
        for k, c in enumerate(token, 1):
            if self._take(c):
                self.text += token[begin:k]
                begin = k
                out += self._give(self.places[-1])
        self.text += token[begin:]
        while place := self._overlong():
            out += self._give(place)
        return out

    def flush(self) -> list[str]:
        rest = self.text.strip()
        self.__init__(self.most, self.least)
        return [rest] if rest else []


_FORMS = (regex.compile(TAG), regex.compile(LINE))


def style_head(head: str) -> tuple[str, str] | None:
    """(style, what follows) of a text that begins with a style tag in either form."""
    led = head.lstrip()
    found = next((m for form in _FORMS if (m := form.match(led))), None)
    return (found[1], led[found.end() :]) if found else None


class StyleParser:
    """Holds back the head of a turn while it may still become a style tag: at most ``MAX_PREFIX`` characters, white space apart."""

    def __init__(self, default: str = DEFAULT_STYLE, style: str | None = None, done: bool = False, held: str = ""):
        self.style = style or (default if default in STYLES else DEFAULT_STYLE)
        self.done, self.held = done, held

    def feed(self, token: str) -> str:
        if self.done:
            return token
        self.held += token
        if told := style_head(self.held):
            self.style, self.done, self.held = told[0], True, ""
            return told[1]
        led = self.held.lstrip()
        open_ = not led or (len(self.held) < MAX_PREFIX and any(form.fullmatch(led, partial=True) for form in _FORMS))
        return "" if open_ else self.flush()

    def flush(self) -> str:
        rest, self.held, self.done = self.held, "", True
        return rest


def sentences_of(tokens: list[str], most: int = 50, least: int = 4, default_style: str = DEFAULT_STYLE) -> tuple[str, list[str]]:
    """(style, sentences) of a whole turn."""
    parser, splitter, out = StyleParser(default_style), Splitter(most, least), []
    for token in tokens:
        out += splitter.feed(parser.feed(token))
    out += splitter.feed(parser.flush())
    return parser.style, out + splitter.flush()


SENTENCES = "session_id string, turn long, number int, style string, sentence string"


def split_turns(tokens: DataFrame, most: int = 50, least: int = 4, default_style: str = DEFAULT_STYLE) -> DataFrame:
    """tokens (session_id, turn, seq, token) -> a row per sentence. One turn is one group."""
    Splitter(most, least)  # limits are checked before any task runs

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        style, out = sentences_of(pdf["token"].fillna("").tolist(), most, least, default_style)
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[0], "turn": pdf["turn"].iloc[0], "number": range(len(out)), "style": style, "sentence": out})

    return tokens.groupBy("session_id", "turn").applyInPandas(go, SENTENCES)


def split_texts(rows: DataFrame, text: Column, most: int = 50, least: int = 4, default_style: str = DEFAULT_STYLE) -> DataFrame:
    """Rows (session_id, turn) with whole texts -> a row per sentence; no shuffle, as a turn is a row. A whole text is one token, so an ending
    anywhere in it comes before a cut at a comma: tokens that arrive one by one are cut as soon as they're overlong."""
    Splitter(most, least)

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [(s, t, k, style, x) for s, t, text in zip(pdf["session_id"], pdf["turn"], pdf["text"], strict=True) for style, xs in (sentences_of([text or ""], most, least, default_style),) for k, x in enumerate(xs)]
            yield pd.DataFrame(out, columns=["session_id", "turn", "number", "style", "sentence"])

    return rows.select(F.col("session_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"), text.alias("text")).mapInPandas(go, SENTENCES)


def stream_sentences(tokens: DataFrame, most: int = 50, least: int = 4, end: str = "\0", default_style: str = DEFAULT_STYLE, idle_minutes: int | None = 10) -> DataFrame:
    """The same over a stream of tokens (session_id, turn, seq, token). A turn ends with the token ``end``, or once no token has come for ``idle_minutes``
    (what it holds is then given out). After an idle time its number and style stay for another, so that late tokens go on counting;
    its state goes then. Give None to a run that ends when its input does, which a timeout by the clock would keep going.
    Tokens of a turn arrive in order of seq across batches and are sorted within one."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    Splitter(most, least)

    def go(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        style, done, held, tail, number = state.get if state.exists else (None, False, "", "", 0)
        parser, splitter, out = StyleParser(default_style, style, done, held), Splitter(most, least), []
        splitter.feed(tail)  # a tail has no ending and isn't overlong, so nothing comes of it
        idle = state.hasTimedOut
        over = idle and not (held or tail or not done)
        batch = [] if idle else pd.concat(list(frames)).sort_values("seq", kind="stable")["token"].fillna("").tolist()
        for token in batch:
            if token == end:
                over = True
                break
            out += splitter.feed(parser.feed(token))
        if over or idle:
            out += splitter.feed(parser.flush()) + splitter.flush()
        if over:
            state.remove()
        else:
            state.update((parser.style, parser.done, parser.held, splitter.text, number + len(out)))
            if idle_minutes is not None:
                state.setTimeoutDuration(idle_minutes * 60_000)
        if out:
            yield pd.DataFrame({"session_id": key[0], "turn": key[1], "number": range(number, number + len(out)), "style": parser.style, "sentence": out})

    state = "style string, done boolean, held string, tail string, number int"
    return tokens.groupBy("session_id", "turn").applyInPandasWithState(go, SENTENCES, state, "append", GroupStateTimeout.NoTimeout if idle_minutes is None else GroupStateTimeout.ProcessingTimeTimeout)
