"""Training-data operators: dedup, quality, decontamination, toxicity,
extraction, token counts and language-model scores over document tables.

Nothing else in the library imports this subpackage.
"""

from pyspark import TaskContext

if TaskContext.get() is not None:
    # in a Python worker: Arrow buffers go back to the system when a batch is done
    import pyarrow

    pyarrow.set_memory_pool(pyarrow.system_memory_pool())
