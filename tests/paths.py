"""Locations used by the tests (a name of its own: several folders have a conftest)."""

import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
