"""Column functions."""

from pairloom.functions.chat_templates import CompiledTemplate, TemplateError, compile_template
from pairloom.functions.hashing import below_fraction, key_hash
from pairloom.functions.messages import ChatTemplate, render_messages, to_messages
from pairloom.functions.text import (
    TLDR_SUFFIX,
    TOPIC_PATTERN,
    extract_key,
    parse_verdict,
    path_label,
    path_label_of,
    render_template,
)

__all__ = [
    "TLDR_SUFFIX", "TOPIC_PATTERN", "ChatTemplate", "CompiledTemplate", "TemplateError", "below_fraction",
    "compile_template", "extract_key", "key_hash", "parse_verdict", "path_label", "path_label_of", "render_messages", "render_template",
    "to_messages",
]
