"""Schemas of what is read and written; nothing is inferred from data."""

VARIABLE = "struct<type:string,addresses:array<string>,agg:struct<is_enum:boolean,is_struct:boolean,is_union:boolean>,register:string,count:int>"
FUNCTION = f"struct<assembly:array<string>,decomp_code:string,variable_metadata:map<string,{VARIABLE}>,args_metadata:map<string,{VARIABLE}>,function_address:struct<start:string,end:string>,func_name:string,mask_code:string>"
CALLS = "struct<caller:array<string>,callee_internal:array<string>,callee_external:array<string>,address:string,is_external:boolean,func_name:string>"
SIDE = "struct<code:string,callee_external:array<string>,callee_internal:array<string>,caller:array<string>>"
PAIR = f"struct<unstripped:{SIDE},stripped:{SIDE},stripped_function_name:string>"
NEIGHBOUR = "struct<kind:string,name:string,text:string>"
FACTS = "struct<file_output:string,ldd_output:string,strings_out:array<string>>"
MESSAGES = "array<struct<role:string,content:string>>"
PREDICTION = "struct<ground_truth:string,predicted_name:string,original_index:int>"
VERDICT = "struct<ground_truth:string,prediction:string,similarity:string,similarity_score:double,error:string>"
#: How an external trainer finds the columns and roles of chat records.
CHAT_DATASET = {"formatting": "sharegpt", "columns": {"messages": "messages"}, "tags": {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant"}}
