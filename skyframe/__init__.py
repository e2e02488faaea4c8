"""skyframe: positional astronomy and data preparation on Spark DataFrames.

The core (``functions``, ``operators``, ``sources``, ``plans``, ``streaming``)
never imports ``skyframe.llm``; that subpackage can be removed as a whole.
"""
