"""Operators for preparing training data at corpus scale.

Conventions shared by every operator here:

* Text is read as whole UTF-8 values; a null text counts as empty unless the docstring says otherwise.
* Results carry the key column plus the columns named in the docstring. Input columns other than those named as
  parameters are ignored, so extra columns, whatever their names, cannot clash with results or with work columns.
* An empty table gives an empty result of the same schema. Repeated rows each get their own result row, and rows with
  equal keys and equal texts get equal results.
"""
