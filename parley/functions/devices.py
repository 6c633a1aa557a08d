"""Classification of audio devices, window titles and errors by ordered rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of device names, first match wins (fixed values).
WIRELESS = (
    "airpods", "bluetooth", "wh-1000xm", "quietcomfort", "freebuds", "galaxy buds", "surface headphones", "beats", "jabra", "plantronics",
    "bt ", " bt", "wireless",
)
VIRTUAL = ("blackhole", "vb-audio", "virtual", "loopback", "monitor")
#: Milliseconds of buffering, least and most, by kind (fixed values).
TIMEOUTS = {"wired": (20, 50), "bluetooth": (80, 200), "unknown": (80, 180)}
#: Errors after which recording may go on (fixed values).
RECOVERABLE = ("DeviceDisconnected", "StreamFailed", "ProcessingFailed", "TranscriptionFailed", "BufferOverflow")
#: Titles of meeting windows in the forms that browsers show (fixed pattern).
MEETING_TITLE = "^Meet - .+|^Meet – .+|^Google Meet - Meet — .+|.+ - Google Meet$"

#: Programs whose windows can hold a meeting (fixed values).
BROWSERS = ("chrome.exe", "msedge.exe", "firefox.exe")


def one_of(c: Column, parts: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(c, F.lit(part))
    return found


def device_kind(name: Column, buffer: Column, rate: Column) -> Column:
    """By name; else by the latency of the buffer: over 50 ms wireless, below 20 ms wired, between unknown."""
    low = F.lower(name)
    ms = F.when((buffer > 0) & (rate > 0), buffer / rate * 1000)
    return F.when(one_of(low, WIRELESS), "bluetooth").when(one_of(low, VIRTUAL), "wired").when(ms > 50, "bluetooth").when(ms < 20, "wired").otherwise("unknown")


def buffer_timeout(kind: Column) -> Column:
    """struct(least, most) in milliseconds."""
    out = F.struct(*(F.lit(x).alias(n) for x, n in zip(TIMEOUTS["unknown"], ("least", "most"))))
    for name in ("wired", "bluetooth"):
        out = F.when(kind == name, F.struct(*(F.lit(x).alias(n) for x, n in zip(TIMEOUTS[name], ("least", "most"))))).otherwise(out)
    return out


def is_meeting_title(title: Column) -> Column:
    return title.rlike(MEETING_TITLE)


def is_meeting_window(title: Column, process: Column) -> Column:
    return is_meeting_title(title) & F.lower(process).isin(*BROWSERS)


def is_recoverable(error: Column) -> Column:
    return error.isin(*RECOVERABLE)
