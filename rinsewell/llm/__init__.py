"""Operators for building training data from text at scale.

Each module holds one operator; ``queries`` registers them over the given tables. Nothing else in the
package imports this subpackage.
"""
