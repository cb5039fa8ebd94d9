"""request bodies for the two reply layouts, by image address or inline image."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the request layouts.
MAX_TOKENS = 16000
MAX_OUTPUT_TOKENS = 65536
TEMPERATURE = 0.0
MIME_TYPE = "image/jpeg"
CHAT_URL = "/v1/chat/completions"
LAYOUTS = ("chat", "generate")


def inline_image(content: Column | str) -> Column:
    """Base64 text of binary image content."""
    return F.base64(content)


def _text(name: str, value: str | int | float | Column) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).alias(name)


def chat_body(image: Column, prompt: str, model: str, inline: bool = False) -> Column:
    """Body with the image address (or data address) and the prompt in one user message."""
    address = F.concat(F.lit(f"data:{MIME_TYPE};base64,"), image) if inline else image
    content = F.array(
        F.struct(
            _text("type", "image_url"),
            F.struct(_text("url", address)).alias("image_url"),
            F.lit(None).cast("string").alias("text"),
        ),
        F.struct(
            _text("type", "text"),
            F.lit(None).cast("struct<url:string>").alias("image_url"),
            _text("text", prompt),
        ),
    )
    return F.struct(
        _text("model", model),
        _text("max_completion_tokens", MAX_TOKENS),
        _text("temperature", TEMPERATURE),
        F.array(F.struct(_text("role", "user"), content.alias("content"))).alias("messages"),
    )


def generate_body(image: Column, prompt: str, max_output_tokens: int = MAX_OUTPUT_TOKENS, inline: bool = False) -> Column:
    """Body with a file (or inline data) part and a text part."""
    if inline:
        name, part = "inline_data", F.struct(_text("mime_type", MIME_TYPE), _text("data", image))
        kind = "struct<mime_type:string,data:string>"
    else:
        name, part = "file_data", F.struct(_text("mime_type", MIME_TYPE), _text("file_uri", image))
        kind = "struct<mime_type:string,file_uri:string>"
    parts = F.array(
        F.struct(part.alias(name), F.lit(None).cast("string").alias("text")),
        F.struct(F.lit(None).cast(kind).alias(name), _text("text", prompt)),
    )
    return F.struct(
        F.array(F.struct(_text("role", "user"), parts.alias("parts"))).alias("contents"),
        F.struct(
            _text("temperature", TEMPERATURE),
            _text("maxOutputTokens", max_output_tokens),
            _text("responseMimeType", "application/json"),
        ).alias("generationConfig"),
    )


def request_line(
    layout: str, key: Column, image: Column, prompt: str, model: str = "", inline: bool = False,
    max_output_tokens: int = MAX_OUTPUT_TOKENS,
) -> Column:
    """One request as JSON text; absent fields are left out."""
    if layout == "chat":
        return F.to_json(
            F.struct(
                key.alias("custom_id"), _text("method", "POST"), _text("url", CHAT_URL),
                chat_body(image, prompt, model, inline).alias("body"),
            )
        )
    if layout == "generate":
        return F.to_json(
            F.struct(key.alias("key"), generate_body(image, prompt, max_output_tokens, inline).alias("request"))
        )
    raise ValueError(f"layout must be one of {LAYOUTS}")
