"""marrow: corpus cleaning, labelling and evaluation as lazy Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver except scalar gates that are documented as such.
"""

from marrow.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
