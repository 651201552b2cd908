"""Scalar expressions: functions from columns to a column, all on Spark built-ins."""

from wardline.functions.scalar import *  # noqa: F401,F403
