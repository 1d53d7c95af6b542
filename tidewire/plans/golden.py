"""Literal rows with known outcomes, as the bundled texts rarely meet a lexical rule."""

from __future__ import annotations

HOUR = 3_600_000
JULY = 1_782_864_000_000  # 2026-07-01T00:00Z

#: (article_id, source_id, source_tier, title, url, published_at, summary, category)
ARTICLES = [
    ("MG01", "tech-press", "E", "OpenAI launches GPT-4o and opens waitlist", "https://news.example/openai-gpt-4o", JULY + 12 * HOUR, "OpenAI launches GPT-4o and opens a waitlist for access.", "models"),
    ("MG02", "openai-blog", "S", "OpenAI launches GPT-5", "https://openai.com/blog/gpt-5", JULY + 226 * HOUR, "OpenAI launches GPT-5 with new capabilities.", "models"),
    ("MG03", "aggregator", "E", "OpenAI launches GPT-4o", "https://aggregator.example/openai-gpt-4o-rehash", JULY + 33 * HOUR, "OpenAI launches GPT-4o, according to the official blog.", "models"),
    ("MG04", "anthropic-blog", "S", "Anthropic launches Claude 4", "https://anthropic.com/news/claude-4", JULY + 11 * HOUR, "Anthropic launches Claude 4.", "generative-ai"),
    ("MG05", "press", "E", "Why generative AI matters this week", "https://press.example/generative-ai-week", JULY + 48 * HOUR, "A broad look at generative AI trends.", "generative-ai"),
    ("MG08", "mistral-news", "S", "Mistral releases Mixtral 8x22B", "https://mistral.ai/news/mixtral-8x22b", JULY + 104 * HOUR, "Mistral releases Mixtral 8x22B.", "models"),
    ("GX01", "anthropic-news", "A", "Announcing Claude Opus 5, our most capable model", "https://anthropic.com/news/opus-5/", JULY, "It is generally available, priced at $15.50, available in Europe.", "models"),
    ("GX02", "openai-news", "S", "Introducing GPT-5.2 — now generally available", "https://openai.com:443/news/gpt-5-2#top", JULY, "The launch is confirmed for customers starting 2026-07-15.", "Modèles"),
    ("GX03", "google-deepmind", "S", "Launching Gemini 3 Pro for developers", "https://deepmind.google/gemini", JULY, "Le lancement a été reporté, annonce Google.", "models"),
    ("GX04", "cursor-changelog", "S", "Cursor 1.5 release notes", "https://cursor.com/changelog?utm_source=x&b=2&a=1&b=3", JULY, "Cursor 1.5 corrects an erratum in the changelog.", "tools"),
    ("GX05", "press", "C", "Meta denies a merger with Cohere", "http://press.example:80/meta", JULY, "Meta denied the false rumor. The deal was cancelled.", "Company"),
]
#: Folders and the articles they begin with.
FOLDERS = [("fld_1", "open", "MG03"), ("fld_gpt5", "idle", "MG02"), ("fld_closed", "closed", "MG08")]
SOURCE_COUNT = 5
