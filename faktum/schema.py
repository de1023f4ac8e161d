"""Enumerations and table schemas of the code-fact model."""

from __future__ import annotations

from pyspark.sql import types as T

# The model's enumerations.
RECORD_KIND = {"function": 0, "method": 1, "class": 2, "interface": 3, "enum": 4, "type_alias": 5, "variable": 6, "field": 7, "parameter": 8, "call": 9, "member": 10, "import": 11, "export": 12, "literal": 13, "comment": 14, "unit": 15, "type_decl": 16, "type_ref": 17, "type_assign": 18, "route": 19, "interface_impl": 20, "import_binding": 21}
CALL_KIND = {"direct": 0, "method": 1, "interface": 2, "constructor": 3, "static": 4, "virtual": 5}
NODE_KIND = {"Function": 0, "Method": 1, "Class": 2, "Struct": 3, "Interface": 4, "Variable": 5, "Macro": 6, "Module": 7, "File": 8}
EDGE_TYPE = {"References": 0, "Calls": 1, "Defines": 2, "Contains": 3, "Imports": 4, "Inherits": 5, "UsesType": 6, "HasType": 7}
VISIBILITY = {"private": 0, "public": 1, "protected": 2}
CALLS = EDGE_TYPE["Calls"]
CALLABLE = (NODE_KIND["Function"], NODE_KIND["Method"])
TYPES = (NODE_KIND["Class"], NODE_KIND["Struct"], NODE_KIND["Interface"])


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"long": T.LongType(), "int": T.IntegerType(), "str": T.StringType(), "double": T.DoubleType(), "bool": T.BooleanType()}[k]) for n, k in (x.split(":") for x in text.split())])


ENTITY = _struct("id:long kind:int name:str qualified_name:str file_path:str module_path:str language:str start_row:int end_row:int visibility:int cyclomatic:int nesting_depth:int cognitive:int")
RELATION = _struct("source_id:long target_id:long type:int confidence:double")
RECORD = _struct("original_id:long kind:int name:str qualified_name:str parent_id:long language:str file_path:str start_row:int start_col:int end_row:int end_col:int arity:int receiver:str call_kind:int strategy:str")
FACT = _struct("id:long function_id:long category:str primitive:str kind:str symbol:str confidence:double line:int")
REFERENCE = _struct("id:long caller_id:long name:str arity:int call_kind:int qualified_target:str receiver_type:str import_alias:str")
CLAIM = _struct("subject:str predicate:str object:str type:int")
