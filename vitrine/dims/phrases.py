"""Script lines by style and voices by persona name."""

from . import texts

# Voice ids per vendor and persona name, and the vendor's default.
VOICES = {
    "elevenlabs": {
        "Aria": "21m00Tcm4TlvDq8ikWAM",
        "Luna": "piTKgcLEGmPEe242Cchg",
        "Nova": "z9fAnwMTq79t1maRnPAg",
        "Sasha": "EXAVITQu4vr4xnSDxMaL",
    },
    "edge": {
        "Aria": "en-US-AvaNeural",
        "Luna": "en-US-AnaNeural",
        "Nova": "en-US-EmmaMultilingualNeural",
        "Sasha": "en-US-JennyNeural",
    },
}
DEFAULT_VOICES = {"elevenlabs": "21m00Tcm4TlvDq8ikWAM", "edge": "en-US-AvaNeural"}


def phrases(spark):
    """(style, hooks, problems), one row per style."""
    rows = [(style, texts.HOOKS[style], texts.PROBLEMS[style]) for style in texts.HOOKS]
    return spark.createDataFrame(
        rows, "style STRING, hooks ARRAY<STRING>, problems ARRAY<STRING>"
    )


def voices(spark):
    """(name, elevenlabs, edge), one row per persona name."""
    names = VOICES["elevenlabs"]
    rows = [(n, VOICES["elevenlabs"][n], VOICES["edge"][n]) for n in names]
    return spark.createDataFrame(rows, "name STRING, elevenlabs STRING, edge STRING")
