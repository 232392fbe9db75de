"""Label conventions: mapping tables and drop sets. Presets, not defaults."""

from __future__ import annotations

# Every table and set below must hold exactly these entries for results to agree.

SILENCE_LABELS = ("sil", "sp", "spn", "sl", "silence", "<sil>", "_")

NON_SPEECH_LABELS = ("", "_", " ", "%", "?", "??", "0", "=", "#", "##", "<p:>", "<unk>")

FILLER_LABELS = ("euh", "eh", "hum", "mm")

SAMPA_TO_IPA = {
    "Z": "ʒ", "A": "a", "S": "ʃ", "R": "ʁ", "r": "ʁ", "N": "ŋ", "J": "ɲ", "H": "ɥ", "g": "ɡ",
    "Z=": "ʒ", "E": "ɛ", "O": "ɔ", "2": "ø", "9": "œ", "@": "ə", "@t": "ə", "a~": "ɑ̃", "o~": "ɔ̃",
    "e~": "ɛ̃", "9~": "ɛ̃", "m=": "m", "n=": "n",
}

ASR_CODE_TO_IPA = {
    "aa": "a", "bb": "b", "kk": "k", "dd": "d", "jj": "dʒ", "ei": "e", "ff": "f", "ii": "i",
    "yy": "j", "ll": "l", "mm": "m", "nn": "n", "au": "o", "pp": "p", "ss": "s", "tt": "t",
    "ch": "ʃ", "ou": "u", "vv": "v", "ww": "w", "uu": "y", "zz": "z", "eu": "ø", "oe": "œ",
    "an": "ɑ̃", "oo": "ɔ", "on": "ɔ̃", "ee": "ə", "ai": "ɛ", "in": "ɛ̃", "un": "ɛ̃", "gn": "ɲ",
    "gg": "ɡ", "uy": "ɥ", "rr": "ʁ", "r": "ʁ", "SIL": "_",
}

NASAL_CANONICAL = {
    "ã": "ɑ̃", "ẽ": "ɛ̃", "ĩ": "ɛ̃", "ỹ": "ɛ̃", "œ̃": "ɛ̃", "ə̃": "ɛ̃", "ø̃": "ɛ̃",
}

NARROW_TO_BROAD = {
    "ɪ": "i", "ʊ": "u", "ɨ": "i", "ɜ": "ə", "ʌ": "ɔ", "ɒ": "ɔ", "ɑ": "a", "ɣ": "ʁ", "ɹ": "ʁ",
    "ɾ": "ʁ", "ʎ": "l", "β": "b", "θ": "t", "c": "k", "mʲ": "m", "ɟ": "ɲ", "ñ": "ɲ", "ṽ": "v",
}

OUT_OF_INVENTORY = ("β", "θ", "ɹ", "ɾ", "ɣ", "ʌ", "ʊ", "ɪ", "ɨ", "ɨ̃", "ɜ", "ɒ", "õ", "ũ")

VOWELS = "aeiouyɛøœɔɑɨɪʊʌɒɜə"

#: Labels the French SAMPA / IPA rules drop before anything else (exact, case-sensitive).
SAMPA_DROPPED = ("_", " ", "sil", "SIL", "spn", "%", "?", "0", "=", "fe~", "Ra~", "sjo~", "~e")

#: Labels the French ASR-code rules drop after markup removal (exact, case-sensitive).
ASR_CODE_DROPPED = ("_", "sil", "spn", "%", "?", "??", "0", "#", "=", "euh", "#erreur#")

COMBINING_TILDE = "̃"
LENGTH_MARK = "ː"
