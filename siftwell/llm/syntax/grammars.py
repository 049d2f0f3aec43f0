"""Grammars, in the notation of ``machine.Grammar``, and the check of one file."""

from __future__ import annotations

import ast
import warnings
from functools import cache

from siftwell.llm.syntax import lexers
from siftwell.llm.syntax.machine import END, Column, Grammar, repair, walk

JSON = """
File = Value ;
Value = STR | NUM | 'true' | 'false' | 'null' | '{' [ Pair { ',' Pair } ] '}' | '[' [ Value { ',' Value } ] ']' ;
Pair = STR ':' Value ;
"""

GO = """
File = 'package' ID ';' { Import ';' } { Top ';' } ;
Import = 'import' ( ImportSpec | '(' [ ImportSpec { ';' ImportSpec } [';'] ] ')' ) ;
ImportSpec = [ '.' | ID ] STR ;
Top = Decl | 'func' ( ID [TypeParams] | Params ID ) Signature [Block] ;
Decl = 'const' ( ConstSpec | '(' [ ConstSpec { ';' ConstSpec } [';'] ] ')' )
     | 'var' ( VarSpec | '(' [ VarSpec { ';' VarSpec } [';'] ] ')' )
     | 'type' ( TypeSpec | '(' [ TypeSpec { ';' TypeSpec } [';'] ] ')' ) ;
Ids = ID { ',' ID } ;
ConstSpec = Ids [ [Type] '=' Exprs ] ;
VarSpec = Ids ( Type [ '=' Exprs ] | '=' Exprs ) ;
TypeSpec = ID [TypeParams] ['='] Type ;
TypeParams = '[' TypeParam { ',' TypeParam } [','] ']' ;
TypeParam = Ids Union ;
Union = ['~'] Type { '|' ['~'] Type } ;
Signature = Params [ Params | Type ] ;
Params = '(' [ Param { ',' Param } [','] ] ')' ;
Param = ['...'] Type | ID ['...'] Type ;
Name = ID [ '.' ID ] [ '[' Type { ',' Type } [','] ']' ] ;
Type = Name | '(' Type ')' | Literal | '*' Type | 'func' Signature | 'chan' ['<-'] Type | '<-' 'chan' Type
     | 'interface' '{' [ Elem { ';' Elem } [';'] ] '}' ;
Literal = '[' ']' Type | '[' Expr ']' Type | '[' '...' ']' Type | 'map' '[' Type ']' Type
     | 'struct' '{' [ Field { ';' Field } [';'] ] '}' ;
Field = ( Ids Type | ['*'] Name ) [STR] ;
Elem = ID Signature | Union ;
Block = '{' Stmts '}' ;
Stmts = [Stmt] { ';' [Stmt] } ;
Stmt = Decl | Simple | 'return' [Exprs] | 'break' [ID] | 'continue' [ID] | 'goto' ID | 'fallthrough' | Block | If
     | 'switch' [ [Simple] ';' ] [Simple] '{' { ( 'case' Types | 'default' ) ':' Stmts } '}'
     | 'select' '{' { ( 'case' Simple | 'default' ) ':' Stmts } '}'
     | 'for' [ [Simple] ';' [Expr] ';' [Simple] | Expr | [ Exprs ( '=' | ':=' ) ] 'range' Expr ] Block
     | 'go' Expr | 'defer' Expr | ID ':' [Stmt] ;
If = 'if' [ [Simple] ';' ] Expr Block [ 'else' ( If | Block ) ] ;
Simple = Exprs [ ASSIGN Exprs | '++' | '--' | '<-' Expr ] ;
Exprs = Expr { ',' Expr } ;
Types = ( Expr | Type ) { ',' ( Expr | Type ) } ;
Expr = Unary { BINARY Unary } ;
Unary = { PREFIX } Operand { Suffix } ;
Operand = ID | VALUE | '(' ( Expr | Type ) ')' | 'func' Signature Block | Literal ( Braces | '(' Expr [','] ')' )
     | ( 'chan' ['<-'] Type | 'interface' '{' '}' ) '(' Expr [','] ')' ;
Suffix = '.' ( ID | '(' ( Type | 'type' ) ')' ) | '[' Index ']' | '(' [ Args ] ')' | Braces ;
Index = [Expr] ':' [Expr] [ ':' Expr ] | ( Expr | Type ) { ',' Type } [','] ;
Args = ( Expr | Type ) { ',' ( Expr | Type ) } ['...'] [','] ;
Braces = '{' [ Item { ',' Item } [','] ] '}' ;
Item = ( Expr | Braces ) [ ':' ( Expr | Braces ) ] ;
"""
GO_CLASSES = {
    "ASSIGN": "= := += -= *= /= %= &= |= ^= <<= >>= &^=".split(),
    "BINARY": "|| && == != < <= > >= + - | ^ * / % << >> & &^".split(),
    "PREFIX": "+ - ! ^ * & <-".split(),
    "VALUE": ["NUM", "STR", "CHAR"],
}

#: Lines that begin with ``js:`` or ``ts:`` belong to that language alone.
JS = """
File = { Item } ;
Item = Stmt
     | 'import' ( STR | Clause 'from' STR ) [ 'with' Object ] SEMI
ts:  | 'import' 'type' Clause 'from' STR SEMI | 'import' NAME '=' 'require' '(' STR ')' SEMI | 'export' '=' Expr SEMI
ts:  | 'export' 'type' ( '*' | '{' [ Spec { ',' Spec } [','] ] '}' ) [ 'from' STR ] SEMI
     | 'export' ( Decl | 'default' ( Function | ClassDecl | !('function' 'class') Assign SEMI )
                | '{' [ Spec { ',' Spec } [','] ] '}' [ 'from' STR [ 'with' Object ] ] SEMI
                | '*' [ 'as' ANY ] 'from' STR SEMI )
ts:  | 'export' 'default' ( 'interface' NAME [TypeParams] [ 'extends' Heritage ] Members | 'abstract' Class )
     ;
Clause = NAME [ ',' ( '*' 'as' NAME | Specs ) ] | '*' 'as' NAME | Specs ;
Specs = '{' [ Spec { ',' Spec } [','] ] '}' ;
Spec =
ts:  ['type']
     ( ANY | STR ) [ 'as' ( ANY | STR ) ] ;
Decl = Function | ClassDecl | Vars SEMI
ts:  | 'interface' NAME [TypeParams] [ 'extends' Heritage ] Members
ts:  | 'type' NAME [TypeParams] '=' Type SEMI
ts:  | ['const'] 'enum' NAME '{' [ EnumItem { ',' EnumItem } [','] ] '}'
ts:  | 'declare' ( Decl | 'global' Block | 'module' STR [Block] | 'function' NAME Call SEMI | ( 'const' | 'let' | 'var' ) NAME ':' Type { ',' NAME ':' Type } SEMI ) | 'abstract' Class
ts:  | ( 'namespace' | 'module' ) NAME { '.' NAME } '{' { Item } '}'
     ;
ts: EnumItem = ( ANY | STR ) [ '=' Assign ] ;
ts: Heritage = Type { ',' Type } ;
Stmt = Decl | Block | ';' | !('{' 'function' 'class') Expr SEMI
     | 'if' '(' Expr ')' Stmt [ 'else' Stmt ]
     | 'for' ['await'] '(' For ')' Stmt | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' [';']
     | ( 'continue' | 'break' ) [NAME] SEMI | 'return' [Expr] SEMI | 'throw' Expr SEMI | 'debugger' SEMI
     | 'with' '(' Expr ')' Stmt | NAME ':' Stmt
     | 'switch' '(' Expr ')' '{' { ( 'case' Expr | 'default' ) ':' { Stmt } } '}'
     | 'try' Block ( 'catch' [ '(' Target Note ')' ] Block [ 'finally' Block ] | 'finally' Block ) ;
For = [ ForVars | Expr ] ';' [Expr] ';' [Expr] | ( ( 'var' | 'let' | 'const' ) Target | Lhs ) ( 'in' Expr | 'of' Assign ) ;
ForVars = ( 'var' | 'let' ) Loose { ',' Loose } | 'const' Strict { ',' Strict } ;
Vars = ( 'var' | 'let' ) Loose { ',' Loose } | 'const' Strict { ',' Strict } ;
Loose = NAME Bang [ '=' Assign ] | Pattern Note '=' Assign ;
Strict = Target Note '=' Assign ;
js: Note = ;
ts: Note = [ ':' Type ] ;
js: Bang = ;
ts: Bang = ['!'] [ ':' Type ] ;
Block = '{' { Stmt } '}' ;
Function = ['async'] 'function' ['*'] [NAME]
js:  Call Block ;
ts:  Call ( Block | SEMI ) ;
js: Call = Params ;
ts: Call = [TypeParams] Params [ ':' Result ] ;
ts: Result = Type | 'asserts' ( NAME | 'this' ) [ 'is' Type ] | ( NAME | 'this' ) 'is' Type ;
Params = '(' [ Param { ',' Param } [','] ] ')' ;
js: Param = ['...'] Target [ '=' Assign ] ;
ts: Param = { Decorator } { 'public' | 'private' | 'protected' | 'readonly' | 'override' } ['...'] ( Target | 'this' ) ['?'] Note [ '=' Assign ] ;
Target = NAME | Pattern ;
Pattern = '[' [ PatItem ] { ',' [ PatItem ] } ']' | '{' [ PatProp { ',' PatProp } [','] ] '}' ;
PatItem = ['...'] Target [ '=' Assign ] ;
PatProp = '...' NAME | NAME [ '=' Assign ] | Key ':' Target [ '=' Assign ] ;
Decorator = '@' ( NAME { '.' ANY } [ Args ] | '(' Expr ')' ) ;
ClassDecl = { Decorator } Class ;
Class = 'class' [NAME]
ts:  [TypeParams]
     [ 'extends' Lhs ]
ts:  [ 'implements' Heritage ]
     '{' { Member } '}' ;
Member = ';' | 'static' Block | { Decorator } { MODIFIER } (
      ['async'] ['*'] Key Opt Call Body
      | ( 'get' | 'set' ) Key Call Body
js:   | Key [ '=' Assign ] SEMI
ts:   | Key ['?' | '!'] Note [ '=' Assign ] SEMI | '[' NAME ':' Type ']' ':' Type SEMI
     ) ;
js: Opt = ;
ts: Opt = ['?'] ;
js: Body = Block ;
ts: Body = Block | SEMI ;
Key = ANY | STR | NUM | PRIV | '[' Assign ']' ;
Expr = Assign { ',' Assign } ;
Assign = ['async'] Arrow | 'yield' [ ['*'] Assign ] | Binary [ '?' Assign ':' Assign | ASSIGN Assign ] ;
Arrow = ( NAME | Head ) '=>' ( Block | !('{') Assign ) ;
js: Head = Params ;
ts: Head = Call ;
Binary = Unary { Operator Unary } ;
js: Operator = BINARY | '>' ;
ts: Operator = BINARY | '>' | '>' '>' | '>' '>' '>' ;
Unary = { PREFIX }
ts:  [ '<' Type '>' ]
     Lhs [ '++' | '--' ]
ts:  { ( 'as' | 'satisfies' ) ( Type | 'const' ) }
     | PRIV 'in' Unary ;
Lhs = { 'new' } Primary { Suffix } ;
Suffix = '.' ( ANY | PRIV ) | '?.' ( ANY | PRIV | '[' Expr ']' | Args ) | '[' Expr ']' | Args | Template
ts:  | '!' | '<' Type { ',' Type } '>' ( Args | Template )
     ;
Args = '(' [ Arg { ',' Arg } [','] ] ')' ;
Arg = ['...'] Assign ;
Template = 'TPL' | HEAD Expr { 'TPLMID' Expr } 'TPLEND' ;
Primary = NAME | VALUE | Template | '[' [ Arg ] { ',' [ Arg ] } ']' | Object | ['async'] 'function' ['*'] [NAME] Call Block
     | { Decorator } Class | '(' Expr ')' | 'import' ( Args | '.' NAME ) | 'new' '.' NAME ;
Object = '{' [ Prop { ',' Prop } [','] ] '}' ;
Prop = '...' Assign | Key ':' Assign | NAME [ '=' Assign ] | ['async'] ['*'] Key Call Block | ( 'get' | 'set' ) Key Call Block ;
ts: TypeParams = '<' TypeParam { ',' TypeParam } [','] '>' ;
ts: TypeParam = { 'const' | 'in' | 'out' } NAME [ 'extends' Type ] [ '=' Type ] ;
ts: Type = [ '|' | '&' ] Part { ( '|' | '&' ) Part } [ 'extends' Type '?' Type ':' Type ] | TypeFn ;
ts: TypeFn = ['abstract'] ['new'] [TypeParams] Params '=>' Result ;
ts: Part = { 'keyof' | 'readonly' | 'unique' | 'infer' } Atom { '[' [Type] ']' } ;
ts: Atom = NAME { '.' ANY } [ TypeArgs ] | 'void' | 'null' | 'this' | 'true' | 'false' | STR | ['-'] NUM | 'TPL' | HEAD Type { 'TPLMID' Type } 'TPLEND'
ts:  | Members | '(' Type ')' | '[' [ Tuple { ',' Tuple } [','] ] ']' | 'typeof' NAME { '.' ANY } [ TypeArgs ] | 'import' '(' STR ')' { '.' NAME } [ TypeArgs ] ;
ts: Tuple = ['...'] [ ANY ['?'] ':' ] Type ['?'] ;
ts: TypeArgs = '<' Type { ',' Type } '>' ;
ts: Members = '{' { TypeMember ( ';' | ',' | 'ASI' ) } [ TypeMember ] '}' ;
ts: TypeMember = { 'readonly' | '+' | '-' } ( Key ['?'] ( Note | Call ) | '[' NAME ':' Type ']' ':' Type | '[' NAME 'in' Type [ 'as' Type ] ']' [ [ '+' | '-' ] '?' ] ':' Type | ( 'get' | 'set' ) Key Call )
ts:  | ['new'] Call ;
"""


def _js_classes(soft: frozenset[str]) -> dict:
    return {
        "NAME": {"ID"} | soft,
        "ANY": {"ID"} | soft | lexers.JS_WORDS,
        "SEMI": [";", "ASI"],
        "VALUE": "NUM STR REGEX this super null true false".split(),
        "ASSIGN": "= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split(),
        "BINARY": "|| && ?? | ^ & == != === !== < <= >= in instanceof << + - * / % **".split(),
        "PREFIX": "! ~ + - ++ -- typeof void delete await".split(),
        "MODIFIER": ["static"] if soft is lexers.JS_SOFT else "static public private protected readonly abstract override declare accessor".split(),
        "HEAD": ["HEAD"],
    }


JAVA = """
File = { Annotation } [ 'package' Qual ';' ] { 'import' ['static'] Qual [ '.' '*' ] ';' | ';' } { Top } ;
Top = ';' | Mods TypeDecl ;
Qual = NAME { '.' NAME } ;
Annotation = '@' Qual [ '(' [ Element { ',' Element } ] ')' ] ;
Element = NAME '=' ElementValue | ElementValue ;
ElementValue = Expr | Annotation | '{' [ ElementValue { ',' ElementValue } ] [','] '}' ;
Mods = { Annotation | MODIFIER } ;
TypeDecl = 'class' NAME [TypeParams] [ 'extends' Type ] [ 'implements' Types ] [ 'permits' Types ] Body
     | 'interface' NAME [TypeParams] [ 'extends' Types ] [ 'permits' Types ] Body
     | 'enum' NAME [ 'implements' Types ] '{' [ Constant { ',' Constant } ] [','] [ ';' { Member } ] '}'
     | 'record' NAME [TypeParams] Formals [ 'implements' Types ] Body
     | '@' 'interface' NAME Body ;
Constant = { Annotation } NAME [Args] [Body] ;
Types = Type { ',' Type } ;
Body = '{' { Member } '}' ;
Member = ';' | Mods ( TypeDecl | Block | [TypeParams] ( Type | 'void' ) NAME Formals { Dims } [ 'throws' Types ] ( Block | [ 'default' ElementValue ] ';' )
     | [TypeParams] NAME [Formals] [ 'throws' Types ] Block | Type Vars ';' ) ;
Formals = '(' [ Formal { ',' Formal } ] ')' ;
Formal = Mods Type [ { Annotation } '...' ] ( NAME | [ NAME '.' ] 'this' ) { Dims } ;
Vars = Var { ',' Var } ;
Var = NAME { Dims } [ '=' ( Expr | ArrayInit ) ] ;
ArrayInit = '{' [ ( Expr | ArrayInit ) { ',' ( Expr | ArrayInit ) } ] [','] '}' ;
Dims = { Annotation } '[' ']' ;
TypeParams = '<' TypeParam { ',' TypeParam } '>' ;
TypeParam = { Annotation } NAME [ 'extends' Type { '&' Type } ] ;
Type = { Annotation } ( PRIM | NAME [TypeArgs] { '.' { Annotation } NAME [TypeArgs] } ) { Dims } ;
TypeArgs = '<' [ TypeArg { ',' TypeArg } ] '>' ;
TypeArg = Type | { Annotation } '?' [ ( 'extends' | 'super' ) Type ] ;
Block = '{' { Stmt } '}' ;
Stmt = Block | ';' | Mods TypeDecl | Mods Type Vars ';' | Expr ';' | NAME ':' Stmt
     | 'if' Paren Stmt [ 'else' Stmt ] | 'while' Paren Stmt | 'do' Stmt 'while' Paren ';'
     | 'for' '(' ( [ Mods Type Vars | Exprs ] ';' [Expr] ';' [Exprs] | Mods Type NAME ':' Expr ) ')' Stmt
     | ( 'break' | 'continue' ) [NAME] ';' | 'return' [Expr] ';' | 'throw' Expr ';' | 'yield' Expr ';'
     | 'synchronized' Paren Block | 'assert' Expr [ ':' Expr ] ';' | Switch
     | 'try' ( Block ( Catch { Catch } [Finally] | Finally ) | '(' Resource { ';' Resource } [';'] ')' Block { Catch } [Finally] ) ;
Resource = Mods Type NAME '=' Expr | Expr ;
Catch = 'catch' '(' Mods Type { '|' Type } NAME ')' Block ;
Finally = 'finally' Block ;
Paren = '(' Expr ')' ;
Switch = 'switch' Paren '{' { Label ( ':' { Stmt } | '->' ( Expr ';' | Block | 'throw' Expr ';' ) ) } '}' ;
Label = 'case' ( CaseItem { ',' CaseItem } ) [ 'when' Expr ] | 'default' ;
CaseItem = Ternary | Match | 'default' ;
Match = Mods Type NAME | Type '(' [ Match { ',' Match } ] ')' [NAME] ;
Exprs = Expr { ',' Expr } ;
Expr = Ternary [ ASSIGN Expr | '>' '>' '=' Expr | '>' '>' '>' '=' Expr ] | Lambda ;
Lambda = ( NAME | '(' [ LParam { ',' LParam } ] ')' ) '->' ( Block | Expr ) ;
LParam = NAME | Mods Type ['...'] NAME { Dims } ;
Ternary = Binary [ '?' Expr ':' ( Ternary | Lambda ) ] ;
Binary = Unary { ( BINARY | '>' | '>' '=' | '>' '>' | '>' '>' '>' ) Unary | 'instanceof' ( Type | Match ) } ;
Unary = { PREFIX } ( Primary { Suffix } [ '++' | '--' ] | '(' Type { '&' Type } ')' ( Unary | Lambda ) | Switch ) ;
Primary = NAME | VALUE | '(' Expr ')' | PRIM { Dims } ( '.' 'class' | '::' 'new' ) | 'void' '.' 'class' | 'new' New
     | NAME [TypeArgs] { '.' NAME [TypeArgs] } { Dims } ( '::' ( NAME | 'new' ) | '.' 'class' ) ;
New = { Annotation } ( NAME [TypeArgs] { '.' NAME [TypeArgs] } | PRIM ) ( Args [Body] | { '[' Expr ']' } { Dims } [ArrayInit] ) ;
Suffix = '.' ( [TypeArgs] NAME | 'this' | 'class' | 'super' | 'new' New ) | '[' Expr ']' | Args | '::' [TypeArgs] ( NAME | 'new' ) ;
Args = '(' [ Exprs ] ')' ;
"""
JAVA_CLASSES = {
    "NAME": {"ID"} | lexers.JAVA_SOFT,
    "MODIFIER": "public protected private static abstract final native synchronized transient volatile strictfp default sealed".split(),
    "PRIM": "boolean byte char short int long float double".split(),
    "VALUE": "NUM STR CHAR true false null this super".split(),
    "ASSIGN": "= += -= *= /= %= &= |= ^= <<=".split(),
    "BINARY": "|| && | ^ & == != < <= << + - * / %".split(),
    "PREFIX": "+ - ! ~ ++ --".split(),
}

RUST = """
File = { Inner } { Item } ;
Inner = '#' '!' '[' Tokens ']' ;
Outer = '#' '[' Tokens ']' ;
Tokens = { PLAIN | '(' Tokens ')' | '[' Tokens ']' | '{' Tokens '}' } ;
Item = { Outer } ( [Vis] ItemBody | MacroItem ) ;
Vis = 'pub' [ '(' ( 'crate' | 'self' | 'super' | 'in' Path ) ')' ] ;
MacroItem = 'macro_rules' '!' NAME ( '{' Tokens '}' | '(' Tokens ')' ';' | '[' Tokens ']' ';' ) | Path '!' [NAME] ( '{' Tokens '}' | '(' Tokens ')' ';' | '[' Tokens ']' ';' ) ;
ItemBody = 'use' UseTree ';' | 'mod' NAME ( ';' | '{' { Inner } { Item } '}' ) | 'extern' 'crate' ( NAME | 'self' ) [ 'as' NAME ] ';'
     | ['unsafe'] 'extern' [STR] '{' { Item } '}' | Fn | 'struct' NAME [Generics] [Where] ( ';' | Fields | Tuple [Where] ';' )
     | 'union' NAME [Generics] [Where] Fields
     | 'enum' NAME [Generics] [Where] '{' [ Variant { ',' Variant } [','] ] '}'
     | 'type' NAME [Generics] [ ':' Bounds ] [Where] [ '=' Type ] [Where] ';'
     | 'const' NAME ':' Type [ '=' Expr ] ';' | 'static' ['mut'] NAME ':' Type [ '=' Expr ] ';'
     | ['unsafe'] ['auto'] 'trait' NAME [Generics] [ ':' [Bounds] ] [Where] '{' { Inner } { Item } '}'
     | ['default'] ['unsafe'] 'impl' [Generics] ['!'] Type [ 'for' Type ] [Where] '{' { Inner } { Item } '}' ;
Fn = { 'const' | 'async' | 'unsafe' | 'default' | 'safe' | 'extern' [STR] } 'fn' NAME [Generics] '(' [ FnParam { ',' FnParam } [','] ] ')' [ '->' Type ] [Where] ( Block | ';' ) ;
FnParam = { Outer } ( [ '&' [LIFE] ] ['mut'] 'self' [ ':' Type ] | Pattern ':' ( Type | '...' ) | '...' ) ;
UseTree = [ '::' ] [ Segment { '::' Segment } '::' ] ( '*' | '{' [ UseTree { ',' UseTree } [','] ] '}' ) | [ '::' ] Segment { '::' Segment } [ 'as' NAME ] ;
Segment = NAME | 'crate' | 'self' | 'super' | 'Self' ;
Fields = '{' [ FieldDecl { ',' FieldDecl } [','] ] '}' ;
FieldDecl = { Outer } [Vis] NAME ':' Type ;
Tuple = '(' [ { Outer } [Vis] Type { ',' { Outer } [Vis] Type } [','] ] ')' ;
Variant = { Outer } [Vis] NAME [ Fields | Tuple ] [ '=' Expr ] ;
Generics = '<' [ Generic { ',' Generic } [','] ] '>' ;
Generic = { Outer } ( LIFE [ ':' [ LIFE { '+' LIFE } ] ] | NAME [ ':' [Bounds] ] [ '=' Type ] | 'const' NAME ':' Type [ '=' ( ['-'] VALUE | Block | NAME ) ] ) ;
Where = 'where' [ WherePart { ',' WherePart } [','] ] ;
WherePart = LIFE ':' [Bounds] | [ForLife] Type ':' [Bounds] ;
ForLife = 'for' Generics ;
Bounds = Bound { '+' Bound } ['+'] ;
Bound = LIFE | ['?'] [ForLife] Path | '(' ['?'] [ForLife] Path ')' | 'use' Generics ;
Path = [ '::' ] PathPart { '::' PathPart } | '<' Type [ 'as' Path ] '>' { '::' PathPart } ;
PathPart = Segment [ ['::'] TypeArgs | '(' [ Type { ',' Type } [','] ] ')' [ '->' Type ] ] ;
TypeArgs = '<' [ TypeArg { ',' TypeArg } [','] ] '>' ;
TypeArg = LIFE | Type | ['-'] VALUE | Block | NAME [TypeArgs] ( '=' Type | ':' Bounds ) ;
Type = Path [ '!' ( '(' Tokens ')' | '[' Tokens ']' | '{' Tokens '}' ) ] | '(' [ Type { ',' Type } [','] ] ')' | '[' Type [ ';' Expr ] ']'
     | ( '&' | '&&' ) [LIFE] ['mut'] Type | '*' ( 'const' | 'mut' ) Type | '!' | '_' | ( 'dyn' | 'impl' ) Bounds
     | [ForLife] { 'unsafe' | 'extern' [STR] } 'fn' '(' [ FnType { ',' FnType } [','] ] ')' [ '->' Type ] | ForLife Path ;
FnType = [ NAME ':' ] Type | '...' ;
Pattern = ['|'] PatPart { '|' PatPart } ;
PatPart = ['-'] VALUE [ RANGE [ ['-'] VALUE | Path ] ] | ['ref'] ['mut'] NAME [ '@' PatPart ] | '..' | RANGE ( ['-'] VALUE | Path )
     | ( '&' | '&&' ) ['mut'] PatPart | '(' [ Pattern { ',' Pattern } [','] ] ')' | '[' [ Pattern { ',' Pattern } [','] ] ']'
     | XPath [ '(' [ Pattern { ',' Pattern } [','] ] ')' | '{' [ PatField { ',' PatField } [','] ] '}' | RANGE [ ['-'] VALUE | Path ] | '!' Tree ] ;
PatField = { Outer } ( ( NAME | NUM ) ':' Pattern | ['box'] ['ref'] ['mut'] NAME | '..' ) ;
Tree = '(' Tokens ')' | '[' Tokens ']' | '{' Tokens '}' ;
Block = '{' { Inner } { Stmt } [ { Outer } !(LIFE 'if' 'match' 'loop' 'while' 'for' '{' 'unsafe') Expr ] '}' ;
Stmt = ';' | Item | { Outer } ( 'let' Pattern [ ':' Type ] [ '=' Expr [ 'else' Block ] ] ';' | !(LIFE 'if' 'match' 'loop' 'while' 'for' '{' 'unsafe') Expr ';' | Whole | Path '!' '{' Tokens '}' ) ;
Whole = BlockLike [ ( '.' Dot | '?' ) { Suffix } { Operator Unary | 'as' Type } ] ;
BlockLike = [ LIFE ':' ] ( If | 'match' Expr '{' { Inner } { Arm } '}' | 'loop' Block | 'while' Expr Block | 'for' Pattern 'in' Expr Block | Block ) | ( 'unsafe' | 'async' ['move'] | 'const' ) Block ;
If = 'if' Expr Block [ 'else' ( If | Block ) ] ;
Arm = { Outer } Pattern [ 'if' Expr ] '=>' ( !(LIFE 'if' 'match' 'loop' 'while' 'for' '{' 'unsafe') Expr [','] | Whole [','] ) ;
Expr = [ 'RET' ] Ranged | Closure | ( 'return' | 'yield' ) [Expr] | 'break' [LIFE] [Expr] | 'continue' [LIFE] ;
Closure = ['static'] ['async'] ['move'] ( '||' | '|' [ CParam { ',' CParam } [','] ] '|' ) ( [ '->' Type ] Expr ) ;
CParam = { Outer } PatPart [ ':' Type ] ;
Ranged = [ Binary ] RANGE [ Binary ] | Binary ;
Binary = Unary { Operator ( Unary | Closure | 'return' [Expr] | RANGE [Unary] ) | 'as' Type } ;
Operator = BINARY | '>' | '>' '>' | '>' '=' | '>' '>' '=' ;
Unary = { '-' | '!' | '*' | '&' | '&&' | '&' 'mut' | '&&' 'mut' | '&' 'raw' ( 'const' | 'mut' ) } ( Primary { Suffix } | 'let' Pattern '=' Unary ) ;
Primary = VALUE | XPath [ '!' Tree | '{' [ Init { ',' Init } [','] ] '}' ] | '(' [ Expr { ',' Expr } [','] ] ')' | '[' [ Expr ( ';' Expr | { ',' Expr } [','] ) ] ']' | BlockLike | Closure ;
Init = { Outer } ( ( NAME | NUM ) [ ':' Expr ] | '..' [Expr] ) ;
XPath = [ '::' ] XPart { '::' XPart } | '<' Type [ 'as' Path ] '>' '::' XPart { '::' XPart } ;
XPart = Segment [ '::' TypeArgs ] ;
Suffix = '?' | '(' [ Expr { ',' Expr } [','] ] ')' | '[' Expr ']' | '.' Dot ;
Dot = NAME [ '::' TypeArgs ] | NUM | 'await' ;
"""


def _rust_classes() -> dict:
    ops = "... ..= .. :: -> => && || == != <= += -= *= /= %= ^= &= |= <<= << + - * / % ^ ! & | < > = @ . , ; : # $ ? ~".split()
    return {
        "NAME": {"ID"} | lexers.RUST_SOFT,
        "VALUE": "NUM STR CHAR true false".split(),
        "RANGE": [".." , "..=", "..."],
        "BINARY": "|| && | ^ & == != < <= << + - * / % = += -= *= /= %= &= |= ^= <<=".split(),
        "PLAIN": {"ID", "NUM", "STR", "CHAR", "LIFE", *ops} | lexers.RUST_WORDS | lexers.RUST_SOFT,
    }


PY = """
File = { Stmt } ;
Stmt = Small { ';' Small } [';'] NEWLINE | Compound ;
Small = 'pass' | 'break' | 'continue' | 'return' [Exprs] | 'raise' [ Expr [ 'from' Expr ] ] | ( 'global' | 'nonlocal' ) ID { ',' ID } | 'del' Exprs | 'assert' Expr [ ',' Expr ]
     | 'import' Dotted [ 'as' ID ] { ',' Dotted [ 'as' ID ] } | 'from' ( Dots [Dotted] | Dotted ) 'import' ( '*' | Names | '(' Names [','] ')' )
     | ID ID [ '[' Exprs ']' ] '=' Expr
     | Exprs [ ':' Expr [ '=' Exprs ] | AUG Exprs | '=' Exprs { '=' Exprs } ] ;
Dots = ( '.' | '...' ) { '.' | '...' } ;
Dotted = ID { '.' ID } ;
Names = ID [ 'as' ID ] { ',' ID [ 'as' ID ] } ;
Suite = Small { ';' Small } [';'] NEWLINE | NEWLINE INDENT Stmt { Stmt } DEDENT ;
Compound = { '@' Named NEWLINE } ( ['async'] 'def' ID [ '[' Exprs ']' ] '(' [ Params ] ')' [ '->' Expr ] ':' Suite | 'class' ID [ '[' Exprs ']' ] [ '(' [ Args ] ')' ] ':' Suite )
     | 'if' Named ':' Suite { 'elif' Named ':' Suite } [ 'else' ':' Suite ] | 'while' Named ':' Suite [ 'else' ':' Suite ]
     | ['async'] 'for' Exprs 'in' Exprs ':' Suite [ 'else' ':' Suite ]
     | 'try' ':' Suite ( 'finally' ':' Suite | 'except' [ '*' ] [ Expr { ',' Expr } [ 'as' ID ] ] ':' Suite { 'except' [ '*' ] [ Expr [ 'as' ID ] ] ':' Suite } [ 'else' ':' Suite ] [ 'finally' ':' Suite ] )
     | ['async'] 'with' ( Expr [ 'as' Expr ] { ',' Expr [ 'as' Expr ] } | '(' Expr [ 'as' Expr ] { ',' Expr [ 'as' Expr ] } [','] ')' ) ':' Suite
     | ID Exprs ':' NEWLINE INDENT { ID Exprs [ 'if' Named ] ':' Suite } DEDENT ;
Params = Param { ',' Param } [','] ;
Param = ( ID | '*' ID | '**' ID ) [ ':' [ '*' ] Expr ] [ '=' Expr ] | '*' | '/' ;
Exprs = Star { ',' Star } [','] ;
Star = '*' Binary | Named ;
Named = Expr [ ':=' Expr ] ;
Expr = 'lambda' [ LParam { ',' LParam } [','] ] ':' Expr | 'yield' [ 'from' Expr | Exprs ] | Binary [ 'if' Binary 'else' Expr ] ;
LParam = ( ID | '*' ID | '**' ID ) [ '=' Expr ] | '*' | '/' ;
Binary = Unary { ( BINARY | 'not' 'in' | 'is' ['not'] ) Unary } ;
Unary = { PREFIX } Atom { '.' ID | '(' [Args] ')' | '[' [Slices] ']' } ;
Atom = ID | NUM | STR { STR } | '...' | 'None' | 'True' | 'False' | '(' [ Group ] ')' | '[' [ Group ] ']' | '{' [ Braced ] '}' ;
Group = Star ( Comp | { ',' Star } [','] ) ;
Braced = '**' Binary { ',' Pair } [','] | Star ( Comp | ':' Expr ( Comp | { ',' Pair } [','] ) | { ',' Star } [','] ) ;
Pair = Expr ':' Expr | '**' Binary ;
Comp = { ['async'] 'for' Exprs 'in' Binary { 'if' Named } } ;
Args = Arg { ',' Arg } [','] ;
Arg = ID '=' Expr | '*' Expr | '**' Expr | Named [ Comp ] ;
Slices = Slice { ',' Slice } [','] ;
Slice = Star [ ':' [Expr] [ ':' [Expr] ] ] | ':' [Expr] [ ':' [Expr] ] ;
"""
PY_CLASSES = {
    "AUG": "+= -= *= /= //= %= **= >>= <<= &= |= ^= @=".split(),
    "BINARY": "or and < > == != <= >= in | ^ & << >> + - * / // % @ **".split(),
    "PREFIX": "not + - ~ await".split(),
}


class ScriptColumn(Column):
    __slots__ = ()

    def _taken(self) -> dict[str, set[str]]:
        out, closed = super()._taken(), self["ASI"]
        if "}" not in out and "}" in (more := Column._taken(closed)):  # a brace that is made stands for a semicolon, too
            out["}"] = more["}"]
        return out

    def goes_on(self, kind: str, follow: set[str], after: str) -> bool:
        bare = after.lstrip("\n")
        return bare in follow or "ASI" in follow and (bare == "}" or after != bare)


class ScriptGrammar(Grammar):
    """With inserted semicolons: a newline (kinds that begin with one), a closing brace or the end may stand for one."""

    free = unmade = frozenset(["ASI"])
    apart = frozenset(["}", "++", "--"])
    column_type = ScriptColumn

    def variants(self, column: Column, kind: str) -> list[Column]:
        if kind[0] != "\n" or (closed := column["ASI"]) is self.dead:
            return [column]
        return [column, closed]

    def _after(self, column: Column, kind: str) -> Column:
        nl = kind[0] == "\n"
        base = kind[1:] if nl else kind
        if nl and base in ("++", "--"):
            closed = column["ASI"] if column is not self.dead else column
            if closed is not self.dead and (out := closed[base]) is not self.dead:
                return out
        out = super()._after(column, base)
        if out is self.dead and base != "ASI" and (nl or base == "}" or base == END):
            closed = super()._after(column, "ASI")
            if closed is not self.dead:
                out = super()._after(closed, base)
        return out


def _only(text: str, keep: str) -> str:
    lines = []
    for line in text.split("\n"):
        if line[:3] in ("js:", "ts:"):
            if line[:3] != keep + ":":
                continue
            line = line[3:]
        lines.append(line)
    return "\n".join(lines)


@cache
def grammar(language: str, role: str = "accept") -> Grammar:
    """The grammar of a language; repairs have one of their own, so that the many columns they try don't crowd out
    those of valid texts."""
    if language == "json":
        return Grammar(JSON, "File")
    if language == "go":
        return Grammar(GO, "File", GO_CLASSES)
    if language == "js":
        return ScriptGrammar(_only(JS, "js"), "File", _js_classes(lexers.JS_SOFT))
    if language == "ts":
        return ScriptGrammar(_only(JS, "ts"), "File", _js_classes(lexers.TS_SOFT))
    if language == "java":
        return Grammar(JAVA, "File", JAVA_CLASSES)
    if language == "rs":
        return Grammar(RUST, "File", _rust_classes())
    if language == "py":
        return Grammar(PY, "File", PY_CLASSES)
    raise KeyError(language)


LEX = {
    "go": lexers.lex_go,
    "js": lexers.lex_js,
    "ts": lexers.lex_ts,
    "java": lexers.lex_java,
    "rs": lexers.lex_rust,
    "json": lexers.lex_json,
    "py": lexers.lex_py,
}
LANGUAGES = tuple(LEX)


def recognised(language: str, text: str) -> bool:
    """Whether the chart takes the text to its end: cost 0."""
    kinds, _ = LEX[language](text)
    g = grammar(language)
    n, column = walk(g, kinds)
    return n == len(kinds) and column[END] is not g.dead


def own_fault(language: str, text: str) -> int | None:
    """The exact check behind the chart: the line at which Python's own parser rejects a text, 0 where it takes it; None
    where there is no such parser, or the text is nested deeper than it goes."""
    if language != "py":
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return 0
    except SyntaxError as e:
        return max(1, e.lineno or 1)
    except ValueError:  # null bytes
        return text.count("\n", 0, max(0, text.find("\0"))) + 1
    except (RecursionError, MemoryError):
        return None


def accepts(language: str, text: str) -> bool:
    """Whether the text is a syntactically valid file: at cost 0 for the chart and, for Python, its own parser."""
    valid, fault = recognised(language, text), own_fault(language, text)
    return valid if fault is None else not fault


def diagnose(language: str, text: str) -> tuple[int, str, list[int], bool]:
    """(edit cost, kind of damage, lines of the edits, whether the cost is known to be the least); cost 0 for a valid file.

    ``conflict``: a merge marker was edited. ``truncation``: the edits are all at the end. ``mismatch``: more than
    one token in twelve was edited. ``local``: any other. A fault that the grammar leaves to the language's own parser (as
    ``f() = 1``) has cost 1, the least that an invalid text can have, and the parser's line."""
    fault = own_fault(language, text)
    if fault == 0 or fault is None and recognised(language, text):
        return 0, "valid", [], True
    kinds, places = LEX[language](text)
    cost, edits, least = repair(grammar(language, "repair"), kinds)
    if cost == 0:
        return 1, "local", [fault or 1], False
    lines = sorted({text.count("\n", 0, places[i]) + 1 if i < len(places) else text.count("\n") + 1 for i, _, _ in edits})
    end = len(kinds) - 1
    if "CONFLICT" in kinds:
        damage = "conflict"
    elif all(i >= end - 2 for i, _, _ in edits):
        damage = "truncation"
    elif 12 * len(edits) > len(kinds):
        damage = "mismatch"
    else:
        damage = "local"
    return cost, damage, lines, least
