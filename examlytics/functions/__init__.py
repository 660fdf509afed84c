from . import constants, json, questions, text  # noqa: F401
