"""Training-data operators.

Ten corpus-scale operators, each by a named method.  Nothing else in the
package imports this subpackage.  ``plumbline.llm.catalog`` lists the queries
and their SQL.
"""
