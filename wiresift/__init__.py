"""Flow inspection over packet and payload tables, expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

from wiresift.spec import InspectSpec, Rule, SignatureString

__all__ = ["InspectSpec", "Rule", "SignatureString"]

# Python workers receive this package's functions with the job, so that they
# need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
