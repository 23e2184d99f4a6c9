"""Sound: header checks and transcript rendering; the engine itself is a hook that is empty by default."""

from __future__ import annotations

import io
import math
import struct
import wave
from dataclasses import dataclass

import numpy as np

from quillspark.converters import hooks
from quillspark.converters.base import ConvertError, Outcome, Segment

MAX_SECONDS, SLACK_FRAMES, MAX_DECODED = 3600, 16, 1 << 30


@dataclass
class Speech:
    start: float
    end: float
    speaker: int
    text: str


def timecode(seconds: float) -> str:
    if not math.isfinite(seconds) or seconds < 0:
        raise ConvertError("adapter_error", f"time {seconds} is out of range")
    s = int(seconds)
    return f"{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02}"


def transcript(segments: list[Speech]) -> str:
    """Lines by start, end and speaker."""
    if any(s.end < s.start for s in segments):
        raise ConvertError("adapter_error", "a segment ends before it starts")
    order = sorted(segments, key=lambda s: (s.start, s.end, s.speaker))
    return "".join(f"[{timecode(s.start)} -> {timecode(s.end)}] Speaker {s.speaker}: {' '.join(s.text.split(chr(10))).strip()}\n" for s in order)


def screen_states(states: list[tuple[float, str]]) -> list[tuple[float, str]]:
    """States by time and text, without those that show what the one before showed."""
    out: list[tuple[float, str]] = []
    for state in sorted(states):
        if not out or out[-1][1] != state[1]:
            out.append(state)
    return out


def samples(data: bytes) -> tuple[np.ndarray, int]:
    """Mono samples of a wave file and their rate, after the ceilings."""
    try:
        with wave.open(io.BytesIO(data)) as file:
            rate, frames, width, channels = file.getframerate(), file.getnframes(), file.getsampwidth(), file.getnchannels()
            if frames > MAX_SECONDS * rate + SLACK_FRAMES:
                raise ConvertError("asr-duration-exceeded", f"{frames / rate:.0f} s is over {MAX_SECONDS} s")
            if frames * channels * 4 > MAX_DECODED:
                raise ConvertError("asr-decoded-exceeded", f"samples exceed {MAX_DECODED} bytes")
            raw = file.readframes(frames)
    except (wave.Error, EOFError, ZeroDivisionError) as e:
        raise ConvertError("asr-malformed", str(e)) from None
    kind = {1: np.uint8, 2: np.int16, 4: np.int32}.get(width)
    if kind is None:
        raise ConvertError("asr-malformed", f"{8 * width} bit samples")
    values = np.frombuffer(raw[: len(raw) // (width * channels) * width * channels], kind).astype(np.float64).reshape(-1, channels).mean(axis=1)
    return (values - 128) / 128 if width == 1 else values / 2 ** (8 * width - 1), rate


#: Kilobits a second of layer III frames by their index, for version 1 and the later ones; samples a second (fixed values).
RATES = ((0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0), (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0))
SAMPLES = (44_100, 48_000, 32_000)


def _flac(data: bytes) -> float:
    if data[:4] != b"fLaC" or len(data) < 42 or data[4] & 0x7F:
        raise ConvertError("asr-malformed", "no stream information")
    word = int.from_bytes(data[18:26], "big")
    rate = word >> 44
    if not rate:
        raise ConvertError("asr-malformed", "no sample rate")
    return (word & (1 << 36) - 1) / rate


def _mp3(data: bytes) -> float:
    at, seconds = 0, 0.0
    if data[:3] == b"ID3" and len(data) > 10:
        at = 10 + sum((b & 0x7F) << 7 * (3 - k) for k, b in enumerate(data[6:10]))
    frames = 0
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] & 0xE6 == 0xE2:
        version, index, sample = data[at + 1] >> 3 & 3, data[at + 2] >> 4, data[at + 2] >> 2 & 3
        if version == 1 or sample == 3 or not RATES[version != 3][index]:
            break
        rate = SAMPLES[sample] // {3: 1, 2: 2, 0: 4}[version]
        samples_in = 1152 if version == 3 else 576
        at += samples_in // 8 * RATES[version != 3][index] * 1000 // rate + (data[at + 2] >> 1 & 1)
        seconds += samples_in / rate
        frames += 1
    if not frames:
        raise ConvertError("asr-malformed", "no frame")
    return seconds


def _m4a(data: bytes) -> float:
    at = data.find(b"mvhd")
    if at < 0 or at + 36 > len(data):
        raise ConvertError("asr-malformed", "no movie header")
    scale, length = struct.unpack_from(">IQ", data, at + 24) if data[at + 4] else struct.unpack_from(">II", data, at + 16)
    if not scale:
        raise ConvertError("asr-malformed", "no time scale")
    return length / scale


def preflight(data: bytes, fmt: str) -> float:
    """Seconds by the headers of a packed recording; raises if it is too long."""
    seconds = {"flac": _flac, "mp3": _mp3, "m4a": _m4a}[fmt](data)
    if seconds > MAX_SECONDS:
        raise ConvertError("asr-duration-exceeded", f"{seconds:.0f} s is over {MAX_SECONDS} s")
    return seconds


def convert(data: bytes, fmt: str) -> Outcome:
    if fmt != "wav":
        seconds = preflight(data, fmt)
        raise ConvertError("engine-unpinned", f"no decoder for {seconds:.0f} s of {fmt}")
    values, rate = samples(data)
    if float((values * values).sum()) < len(values) / 2**30:
        raise ConvertError("asr-no-speech", "the recording is silent")
    engine = hooks.engine("speech")
    if engine is None:
        raise ConvertError("asr-runtime-missing", "no speech engine is installed")
    said = engine(values, rate)
    segments, media, tool = said if isinstance(said, tuple) else (said, {}, None)
    if not segments:
        raise ConvertError("asr-no-speech", "the engine heard nothing")
    text = transcript(segments)
    media = {"duration_seconds": len(values) / rate, "speaker_count": len({s.speaker for s in segments})} | media
    return Outcome(text, "asr-adapter", [], [Segment("span", 0, len(text.encode()), "document")], "transcript", media=media, tool_version=tool)
