"""Training-data operators: language, decontamination, quality, mixing, near-duplicates, secrets,
chat formatting, token counts and toxicity.

Nothing outside this subpackage imports it.  Python workers import it by name, so on a cluster the
package has to be installed on the executors or sent with ``--py-files``.
"""
