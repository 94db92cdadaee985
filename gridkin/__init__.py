"""Set similarity as Spark DataFrame verbs.

A set is a group of rows ``(set_id, cell)`` (or one row ``(set_id, cells)``) over a d-dimensional
grid.  Sub-packages:

* ``functions``  column expressions (grid arithmetic, parsing, hashing, comparison);
* ``operators``  DataFrame -> DataFrame building blocks;
* ``sources``    readers and writers;
* ``plans``      the user-level verbs composed from the operators;
* ``streaming``  Structured Streaming forms;
* ``catalog``    the registered queries with their SQL twins.
"""

__version__ = "0.1.0"
