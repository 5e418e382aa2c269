"""vitrine: product-catalogue search and recommendation as Spark jobs.

Subpackages:

* ``sources``   -- readers, writers and adapters of the input tables
* ``functions`` -- Column functions (cleaning, text hashing, vectors, formats)
* ``operators`` -- DataFrame operators (clean, analytics, embed, k-NN, recommend)
* ``plans``     -- the catalogue build and the registered queries
* ``streaming`` -- search and recommendation requests served as a stream, and the
  interaction statistics kept up to date over new event files
* ``api``       -- the reference's endpoints (search, product, recommendations) as functions
"""

__version__ = "0.1.0"
