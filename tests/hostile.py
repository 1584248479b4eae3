"""Values that must never be stored as a name, built rule by rule around given words."""


def not_names(word: str, other: str) -> list[str]:
    """Each entry breaks exactly one rule of names."""
    spaced = [word + gap + other for gap in (" ", "\t", "\n", "\r", "\u2003")]
    separated = [word + mark + other for mark in ("/", "\\", ",", ";", "=", "*", "~", "$", "%")]
    starts = [mark + word for mark in (".", "..", "-", "_", "/", "\\", "~", "@", ":", "+")]
    drives = [f"{letter}:{word}" for letter in "qZ"]
    ends = [word + "/", word + "\\", word + "\0"]
    return [*spaced, *separated, *starts, *drives, *ends, word * (128 // len(word) + 1), f"{word}é", ""]


def not_scoped(word: str, other: str) -> list[str]:
    """Scopes (a path before the colon) and names of scopes that are refused."""
    broken_scopes = [f"/{word}", f"{word}/", f"./{word}", f"../{word}", f"{word}/../{other}", f"{word}//{other}", f"~/{word}",
                     f"k:/{word}", f"{word}\\x/{other}"]
    broken_names = ["", f"{word} {other}", f"{word}/{other}"]
    return [f"{scope}:{other}" for scope in broken_scopes] + [f"{word}/{other}:{name}" for name in broken_names] + [
        f"/{word}/{other}", f"{word}/{other}/x"]
