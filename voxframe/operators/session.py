"""What one utterance leaves for the next: end markers, continuation, expiry, debouncing, application state.

The decision functions work on plain values, so that batch folds and streaming state share them; what needs no state is
also there as column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.text import FORCED_END, NBSP, NNBSP
from voxframe.operators.folds import Fold, fold_in_order

#: Final characters and the marker they leave, longest first; ? and ! depend on the language.
ENDS = (("...", ".3"), ("..", ".2"), ("…", ".3"), (".", ".1"), (",", ","), (";", "F"), (":", "F"), (")", "F"), ("»", "F"))


@dataclass(frozen=True)
class End:
    """How a text ended: marker "," ".N" "F" "_", or "H<n>_" when an indicator of n characters was appended."""

    marker: str
    last_word: str

    def __str__(self) -> str:
        return f"{self.marker}:{self.last_word}"


def end_of(text: str, lang: str = "fr", words: frozenset[str] = frozenset(), indicator: str = "") -> tuple[str, End | None]:
    """The text as shown, and its end; None (state deleted) for empty texts and texts with a newline.

    A last word that calls for more gets the indicator appended, if there is one.
    """
    if not text.strip() or "\n" in text:
        return text, None
    bare = text.rstrip()
    marker = next((m for s, m in ENDS if bare.endswith(s)), "_")
    if bare.endswith("?"):
        marker = ".2" if lang == "fr" else ".1"
    elif bare.endswith("!"):
        marker = ".2" if lang == "fr" else "F"
    if FORCED_END in text:
        marker = "F"
    tokens = bare.replace(FORCED_END, "").split()
    last = tokens[-1].split("-")[-1].strip(".,;:!?…)»\"'").lower() if tokens else ""
    if last in words and (marker.startswith(".") or marker == "_") and indicator:
        return text + indicator, End(f"H{len(indicator)}_", last)
    return text, End(marker, last)


def continue_text(
    end: End | None,
    text: str,
    lang: str = "fr",
    words: frozenset[str] = frozenset(),
    keywords: tuple[str, ...] = (),
    keep_capitals: bool = False,
) -> tuple[str, int]:
    """The new text as it joins what is shown, and how many characters are taken back first."""
    if end is None or text.startswith("\n"):
        return text, 0

    def lower(t: str) -> str:
        return t if keep_capitals else t[:1].lower() + t[1:]

    marker, back = end.marker, 0
    if marker.startswith("H"):
        digits = marker[1:].rstrip("_")
        back, marker = int(digits or 0), "_"
    old = int(marker[1:]) if marker.startswith(".") else 1 if marker == "," else 0
    low = text.lower()
    for keyword in sorted(keywords, key=len, reverse=True):
        if low == keyword or low.startswith((keyword + " ", keyword + ",")):
            rest = text[len(keyword) :].lstrip(" ,")
            return (" " + rest[:1].lower() + rest[1:]) if rest else "", back + old
    if text[:1] and text[0] in ",.;!?:":
        gap = (NBSP if text[0] == ":" else NNBSP if text[0] in ";!?" else "") if lang == "fr" else ""
        head, rest = text[0], text[1:]
        if head in ",;:" and "\n" not in rest[:2]:
            body = rest.lstrip(" ")
            rest = rest[: len(rest) - len(body)] + lower(body)
        return gap + head + rest, back + old
    if marker == ",":
        return " " + lower(text), back
    if marker.startswith("."):
        return (" " + lower(text), back + old) if end.last_word in words else (" " + text, back)
    if marker == "F":
        return " " + text, back
    return " " + lower(text), back


def end_marker(t: Column, lang: Column) -> Column:
    """marker:last_word of a text, null for empty texts and texts with a newline (without an indicator)."""
    bare = F.regexp_replace(t, "(?U)\\s+$", "")
    chain = F.when(F.contains(t, F.lit(FORCED_END)), "F")
    chain = chain.when(F.endswith(bare, F.lit("?")), F.when(lang == "fr", ".2").otherwise(".1"))
    chain = chain.when(F.endswith(bare, F.lit("!")), F.when(lang == "fr", ".2").otherwise("F"))
    for end, marker in ENDS:
        chain = chain.when(F.endswith(bare, F.lit(end)), marker)
    last = F.element_at(F.split(F.element_at(F.split(F.replace(bare, F.lit(FORCED_END), F.lit("")), "(?U)\\s+"), -1), "-"), -1)
    word = F.lower(F.regexp_replace(last, "^[.,;:!?…)»\"']+|[.,;:!?…)»\"']+$", ""))
    return F.when((bare != "") & ~F.contains(t, F.lit("\n")), F.concat(chain.otherwise("_"), F.lit(":"), word))


def fold_utterances(
    utterances: DataFrame, words: dict[str, frozenset[str]], keywords: tuple[str, ...] = (), ttl: int | None = None
) -> DataFrame:
    """(user_id, seq, shown, back, state) of utterances (user_id, seq, ts, lang, text), each seeing the one before.

    What is shown depends on the end of the text before it, which depends on that text as changed: a fold over a user's
    utterances by time, then ``seq``.  ``ttl``: seconds after which the end is forgotten; a gap of just that many still counts.
    """
    return fold_in_order(utterances, ["user_id"], ["ts", "seq"], Utterances(words, keywords, ttl), "ts" if ttl is not None else None)


class Utterances(Fold):
    """What is shown of utterances (user_id, seq, ts, lang, text); the memory is the end of the text before and its time."""

    columns = "user_id long, seq long, shown string, back long, state string"

    def __init__(self, words: dict[str, frozenset[str]], keywords: tuple[str, ...] = (), ttl: int | None = None):
        self.words, self.keywords, self.ttl = words, keywords, ttl
        self.idle = None if ttl is None else ttl * 1000.0

    def rows(self, key: tuple, memory: tuple | None, frame: pd.DataFrame) -> tuple[tuple | None, list[tuple]]:
        end, last = memory or (None, None)
        out = []
        for seq, ts, lang, text in zip(*(frame[c] for c in ("seq", "ts", "lang", "text")), strict=True):
            text = text or ""
            if self.ttl is not None and last is not None and (ts - last).total_seconds() > self.ttl:
                end = None
            mine = self.words.get(lang, frozenset())
            shown, back = continue_text(end, text, lang, mine, self.keywords)
            if text.strip():
                _, end = end_of(shown, lang, mine)
                last = ts
            out.append((key[0], seq, shown, back, str(end) if end else None))
        return (end, last), out


def expiring_sessions(events: DataFrame, seconds: float) -> DataFrame:
    """Events (user_id, ts, ...) with session_no: a new session begins after a gap over ``seconds``."""
    w = Window.partitionBy("user_id").orderBy("ts")
    at = F.col("ts").cast("timestamp").cast("double")
    gap = at - F.lag(at).over(w)
    return events.withColumn("_new", F.coalesce((gap > seconds).cast("long"), F.lit(0))).withColumn(
        "session_no", F.sum("_new").over(w)
    ).drop("_new")


@dataclass
class KeyState:
    """A push-to-talk key: whether it is held and recording, and when it last did something (milliseconds)."""

    held: bool = False
    recording: bool = False
    accepted: float = -1e18
    stopped: float = -1e18
    pressed: float = -1e18


def key_event(state: KeyState, ms: float, value: int, debounce: float = 150, cooldown: float = 500, hold: float = 300) -> str:
    """What a key event (1 down, 0 up, 2 repeat) does: start, stop, cancel or ignore.  The state is changed."""
    if value == 2 or (value == 1 and state.held and ms - state.pressed < 3000):
        return "ignore"
    if value == 1:
        state.held, state.pressed = True, ms
        if ms - state.accepted < debounce or ms - state.stopped < cooldown:
            return "ignore"
        state.accepted, state.recording = ms, True
        return "start"
    if not state.held:
        return "ignore"
    state.held = False
    if not state.recording:
        return "ignore"
    state.recording, state.stopped = False, ms
    return "cancel" if ms - state.pressed < hold else "stop"


class Keys(Fold):
    """Actions of key events (user_id, ms, value).  A key that is neither held nor recording is forgotten after a while."""

    columns = "user_id long, ms double, value int, action string"

    def __init__(self, debounce: float = 150, cooldown: float = 500, hold: float = 300):
        self.limits = (debounce, cooldown, hold)
        self.idle = max(10_000.0, *self.limits)

    def start(self, key: tuple) -> KeyState:
        return KeyState()

    def over(self, memory: KeyState) -> bool:
        return not (memory.held or memory.recording)

    def rows(self, key: tuple, memory: KeyState, frame: pd.DataFrame) -> tuple[KeyState, list[tuple]]:
        events = zip(frame["ms"].tolist(), frame["value"].tolist(), strict=True)
        return memory, [(key[0], ms, value, key_event(memory, ms, value, *self.limits)) for ms, value in events]


def debounce_keys(events: DataFrame, debounce: float = 150, cooldown: float = 500, hold: float = 300) -> DataFrame:
    """(user_id, ms, value, action) of key events (user_id, ms, value): a fold, for the last accepted event decides."""
    return fold_in_order(events, ["user_id"], ["ms", "value"], Keys(debounce, cooldown, hold), None)


def application_state(events: DataFrame) -> DataFrame:
    """(user_id, ts, state) of requested states: "idle" does not replace "offline"."""
    w = Window.partitionBy("user_id").orderBy("ts")
    # A run of idle requests keeps what was before it: offline if that was offline
    solid = F.last(F.when(F.col("state") != "idle", F.col("state")), ignorenulls=True).over(w)
    shown = F.when((F.col("state") == "idle") & (solid == "offline"), "offline").otherwise(F.col("state"))
    return events.withColumn("shown", shown)
