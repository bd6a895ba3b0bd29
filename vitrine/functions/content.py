"""Content planning: categories, prompts, panels, scripts."""

import re

from pyspark.sql import functions as F

from ..dims import texts
from . import as_col
from .picks import draw_from


def _contains_any(c, words):
    found = F.lit(False)
    for word in words:
        found = found | c.contains(word)
    return found


def fill(template, fields):
    """Concatenate a template's text with a column for each ``{field}``."""
    parts = []
    for i, piece in enumerate(re.split(r"\{([^{}]+)\}", template)):
        if i % 2:
            parts.append(fields(piece) if callable(fields) else as_col(fields[piece]))
        elif piece:
            parts.append(F.lit(piece))
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def product_category(name, description):
    """First category with a word found anywhere in name or description."""
    text = F.lower(
        F.concat(
            F.coalesce(as_col(name), F.lit("")),
            F.lit(" "),
            F.coalesce(as_col(description), F.lit("")),
        )
    )
    chain = F
    for category, words in texts.CATEGORY_WORDS.items():
        chain = chain.when(_contains_any(text, words), F.lit(category))
    return chain.otherwise(F.lit(texts.DEFAULT_CATEGORY))


def rewrite_motion(prompt, product, description):
    """Put the product in place of generic garments; calm the motion of fitted items."""
    product, description = as_col(product), as_col(description)
    text = as_col(prompt)
    for generic in texts.GENERIC_GARMENTS:
        text = F.replace(text, F.lit(generic), product)
    text = F.replace(text, *map(F.lit, texts.PLAIN_FABRIC))
    calm = text
    for old, new in texts.FITTED_MOTION:
        calm = F.replace(calm, F.lit(old), F.lit(new))
    fitted = _contains_any(F.lower(product), texts.FITTED_WORDS) | _contains_any(
        F.lower(description), texts.FITTED_WORDS
    )
    return F.when(fitted, calm).otherwise(text)


def persona_prompt(name, description, persona=None, template=texts.PERSONA_PROMPT):
    """Photo prompt from a persona's columns; ``persona`` names a struct holding them."""

    def field(path):
        if path in ("name", "description"):
            return as_col({"name": name, "description": description}[path])
        head, _, key = path.partition(".")
        column = F.col(f"{persona}.{head}" if persona else head)
        return column[key] if key else column

    return F.trim(fill(template, field), F.lit(" \n"))


def storyboard_panels(name, model, duration):
    """Nine panels: detailed beats up to five seconds, numbered beats beyond."""
    fields = {"name": as_col(name), "model": as_col(model)}

    def panel(n, seconds, beat):
        return F.struct(
            F.lit(n).alias("panel"), F.lit(seconds).alias("duration"), beat.alias("beat")
        )

    short = F.array(
        *[panel(i + 1, s, fill(b, fields)) for i, (s, b) in enumerate(texts.SHORT_PANELS)]
    )
    seconds, beat = texts.LONG_PANEL
    long = F.array(
        *[panel(i + 1, seconds, F.lit(beat.format(n=i + 1))) for i in range(len(texts.SHORT_PANELS))]
    )
    return F.when(as_col(duration) <= 5, short).otherwise(long)


def video_script(name, hooks, problems, key, seed=0):
    """Hook, problem and call to action, one of each drawn by key."""
    calls = F.array(*[F.lit(t) for t in texts.CALLS])
    hook = F.replace(draw_from(as_col(hooks), key, seed, "hook"), F.lit("{name}"), as_col(name))
    return F.concat_ws(
        " ",
        hook,
        draw_from(as_col(problems), key, seed, "problem"),
        draw_from(calls, key, seed, "call"),
    )


def clip_duration(seconds):
    """Seconds mapped to the provider's allowed values."""
    s = as_col(seconds)
    return F.when(s <= 5, "5").when(s <= 8, "8").otherwise("10")


def keyframe_prompt(motion):
    return fill(texts.KEYFRAME, {"motion": as_col(motion)})


def tag_prompts(text, categories):
    """Category extraction and rewrite prompts of a product text."""
    fields = {"text": as_col(text), "categories": as_col(categories)}
    return F.struct(
        fill(texts.TAG_SYSTEM, fields).alias("system"),
        fill(texts.TAG_REQUEST, fields).alias("extract"),
        fill(texts.REWRITE_REQUEST, fields).alias("rewrite"),
    )
