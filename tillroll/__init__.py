"""tillroll: invoice-line analytics on Spark DataFrames.

Profile, quality-check, clean and analyse e-commerce invoice lines, and
build the tables behind a dashboard, a report and a run log. Every step is a
function ``DataFrame -> DataFrame``; nothing is collected to the driver
except results whose size is bounded by months, columns or a top-k.
"""

__version__ = "0.1.0"
