"""Recording lengths from container headers; samples are never decoded."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame

from segmark.sources import stores


# kbit/s and samples/s of layer III frames by their index in a frame's header.
MPEG1_RATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
MPEG2_RATES = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
SAMPLE_RATES = (44100, 48000, 32000)
#: Bytes looked at for the last page of an OGG file and the first frame of an MP3 file.
TAIL, SEARCH = 1 << 16, 1 << 16


def riff_duration(read, size: int) -> float:
    at, rate, align, wide = 12, None, None, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", read(at, 8))
        if name == b"ds64":
            wide = struct.unpack("<Q", read(at + 16, 8))[0]
        elif name == b"fmt ":
            rate, align = struct.unpack("<4xI4xH", read(at + 8, 14))
        elif name == b"data":
            if not rate or not align:
                raise ValueError("no format chunk before the data")
            length = wide if length == 0xFFFFFFFF and wide is not None else min(length, size - at - 8)
            return (length // align) / float(rate)
        at += 8 + length + (length & 1)
    raise ValueError("no data chunk")


def ogg_duration(read, size: int) -> float:
    """From the sample count that the last page ends with."""
    first = read(0, 4096)
    vorbis, opus = first.find(b"\x01vorbis"), first.find(b"OpusHead")
    if vorbis >= 0:
        rate, skip = struct.unpack_from("<I", first, vorbis + 12)[0], 0
    elif opus >= 0:
        rate, skip = 48000, struct.unpack_from("<H", first, opus + 10)[0]
    else:
        raise ValueError("an OGG file of neither Vorbis nor Opus")
    tail = read(max(0, size - TAIL), TAIL)
    at = tail.rfind(b"OggS")
    ended = struct.unpack_from("<q", tail, at + 6)[0] if at >= 0 and len(tail) >= at + 14 else -1
    if ended < 0 or not rate:
        raise ValueError("no last page with a sample count")
    return max(0, ended - skip) / float(rate)


def mp3_duration(read, size: int) -> float:
    """From the frame count in the first frame, else from the size at that frame's bit rate."""
    at = 0
    head = read(0, 10)
    if head[:3] == b"ID3":
        length = head[6] << 21 | head[7] << 14 | head[8] << 7 | head[9]
        at = 10 + length + (10 if head[5] & 0x10 else 0)
    data = read(at, SEARCH)
    for k in range(len(data) - 3):
        word = int.from_bytes(data[k : k + 4], "big")
        version, layer, kbps, rate = word >> 19 & 3, word >> 17 & 3, word >> 12 & 15, word >> 10 & 3
        if word >> 21 == 0x7FF and version != 1 and layer == 1 and 0 < kbps < 15 and rate < 3:
            break
    else:
        raise ValueError("no layer III frame")
    one = version == 3
    samples = 1152 if one else 576
    hertz = SAMPLE_RATES[rate] / (1 if one else 2 if version == 2 else 4)
    mono = word >> 6 & 3 == 3
    tag = k + 4 + ((17 if mono else 32) if one else (9 if mono else 17))
    if data[tag : tag + 4] in (b"Xing", b"Info") and data[tag + 7] & 1:
        total = int.from_bytes(data[tag + 8 : tag + 12], "big") * samples
        if data[tag + 120 : tag + 124] in (b"LAME", b"Lavc", b"Lavf"):
            trim = int.from_bytes(data[tag + 141 : tag + 144], "big")
            total -= (trim >> 12) + (trim & 0xFFF)
        return max(0, total) / hertz
    if data[k + 36 : k + 40] == b"VBRI":
        return int.from_bytes(data[k + 50 : k + 54], "big") * samples / hertz
    end = size - (128 if size >= 128 and read(size - 128, 3) == b"TAG" else 0)
    return (end - at - k) * 8 / ((MPEG1_RATES if one else MPEG2_RATES)[kbps] * 1000.0)


def header_duration(read, size: int) -> float:
    """Seconds of a WAV, FLAC, OGG or MP3 file; ``read(offset, length)`` returns bytes."""
    head = read(0, 42)
    if head[:4] == b"fLaC":
        packed = int.from_bytes(head[18:26], "big")
        return (packed & ((1 << 36) - 1)) / float(packed >> 44)
    if head[:4] in (b"RIFF", b"RF64") and head[8:12] == b"WAVE":
        return riff_duration(read, size)
    if head[:4] == b"OggS":
        return ogg_duration(read, size)
    if head[:3] == b"ID3" or head[:1] == b"\xff" and len(head) > 1 and head[1] >= 0xE0:
        return mp3_duration(read, size)
    raise ValueError("neither WAV, FLAC, OGG nor MP3")


def durations(files: DataFrame) -> DataFrame:
    """(path, duration_s, error) for a table of paths; each task reads a few header bytes per file."""

    def run(batches):
        for pdf in batches:
            seconds, errors = [], []
            for path in pdf["path"]:
                try:
                    store, name = stores.locate(path)
                    with store.open_input_file(name) as f:
                        seconds.append(header_duration(lambda at, n: (f.seek(at), f.read(n))[1], f.size()))
                    errors.append(None)
                except Exception as exc:  # one unreadable file must not end the job
                    seconds.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield pd.DataFrame(
                {"path": pdf["path"], "duration_s": pd.array(seconds, "Float64"), "error": errors}
            )

    return files.select("path").mapInPandas(run, "path string, duration_s double, error string")
