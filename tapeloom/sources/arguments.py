"""Default arguments from one string, split as a small shell would."""


def split(text: str) -> list[str]:
    """Quotes of either kind group, a backslash takes the next character as it is, inside quotes too; empty arguments vanish."""
    out, now, quote = [], "", ""
    chars = iter(text)
    for c in chars:
        if c == "\\":
            now += next(chars, "\\")
        elif quote:
            now, quote = (now, "") if c == quote else (now + c, quote)
        elif c in "'\"":
            quote = c
        elif c.isspace():
            out, now = [*out, now] if now else out, ""
        else:
            now += c
    return [*out, now] if now else out


def merged(arguments: list[str], defaults: str | None) -> list[str]:
    """The defaults before the arguments."""
    return [*(split(defaults) if defaults and defaults.strip() else ()), *arguments]
