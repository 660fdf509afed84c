from . import dashboard, parse, prompts, results, sessions  # noqa: F401
