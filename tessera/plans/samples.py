"""One small file in each language, and what its extraction must give, read off the file by hand."""

from __future__ import annotations

#: path, content
FILES = (
    ('lib/shop.py', '"""Shop."""\nimport json\n\nclass Base:\n    pass\n\n@dataclass\nclass Shop(Base):\n    """Sells things."""\n    name: str\n\n    def __init__(self, store: Store):\n        self.store = store\n\n    def sell(self, n: int) -> Receipt:\n        """Takes one.\n\n        Args:\n            n: how many\n        """\n        if n > 0 and self.open:\n            for i in range(n):\n                self.log(i)\n        raise SoldOut(n)\n\n    def _hide(self):\n        pass\n\ndef test_sell():\n    helper()\n\nasync def helper():\n    return json.dumps({})\n'),
    ('web/cart.ts', '/** Holds items. */\nexport class Cart extends Base implements Store {\n  private items: Item[] = [];\n  constructor(private api: Api) { super(); }\n  /** Adds one. */\n  async add(item: Item): Promise<void> {\n    if (item) { for (const x of this.items) { log(x); } }\n  }\n}\nexport interface Store { add(item: Item): void; }\nexport enum Size { S, M }\nexport type Id = string;\nexport const total = (a: number) => { return sum(a); };\nfunction sum(a: number) { return a > 0 ? a : 0; }\n'),
    ('src/Bank.java', 'package org.bank;\nimport java.util.List;\n/** Keeps accounts. */\npublic class Bank extends Base implements Store {\n    private final Ledger ledger;\n    public Bank(Ledger ledger) { this.ledger = ledger; }\n    /** Pays out. */\n    protected Receipt pay(int n) {\n        while (n > 0) { n--; log(n); }\n        throw new IllegalStateException();\n    }\n}\ninterface Store { }\nenum Kind { A, B }\nclass BankTest {\n    @Test\n    void paysOut() { new Bank(null).pay(1); }\n}\n'),
    ('pkg/net.go', 'package net\n\nimport "fmt"\n\n// Dial opens a line.\nfunc Dial(host string) error {\n\tif host == "" {\n\t\treturn errNone\n\t}\n\tfmt.Println(host)\n\treturn nil\n}\n\n// Conn is open.\ntype Conn struct {\n\thost string\n}\n\ntype Closer interface {\n\tClose() error\n}\n\nfunc (c *Conn) close() { Dial(c.host) }\n\nfunc TestDial(t *testing.T) { Dial("x") }\n'),
    ('src/cache.rs', 'use std::fmt;\n\n/// Keeps pages.\npub struct Cache { size: usize }\n\npub trait Store { fn get(&self) -> u8; }\n\nimpl Store for Cache {\n    /// Gets one.\n    fn get(&self) -> u8 {\n        match self.size { 0 => fail(), _ => 1 }\n    }\n}\n\npub enum Kind { A, B }\n\nfn fail() -> u8 { 0 }\n\n#[test]\nfn gets_one() { fail(); }\n'),
    ('src/Mail.php', '<?php\nnamespace App\\Mail;\nuse App\\Core\\Base;\n/** Sends mail. */\nclass Mail extends Base implements Sender {\n    private $to;\n    public function __construct(Queue $queue) { $this->queue = $queue; }\n    /** Sends one. */\n    public function send(int $n): bool {\n        if ($n) { foreach ($this->to as $t) { push($t); } }\n        return true;\n    }\n}\ninterface Sender { public function send(int $n): bool; }\nfunction push($t) { return 1; }\n'),
    ('src/UserController.cs', 'namespace Shop.Api;\n/// <summary>Users.</summary>\npublic class UserController : ControllerBase, IUsers\n{\n    private readonly IStore _store;\n    public UserController(IStore store) { _store = store; }\n    /// <summary>Creates one.</summary>\n    [HttpPost("users")]\n    public async Task<ActionResult<UserDto>> Create([FromBody] CreateUserDto dto)\n    {\n        if (dto == null) { throw new ArgumentException(); }\n        try { Save(dto); } catch (IOException e) { }\n        return Ok();\n    }\n    internal void Save(CreateUserDto dto) { _store.Put(dto); }\n}\npublic interface IUsers { }\npublic record CreateUserDto(string Name);\npublic enum Kind { A, B }\npublic class UserTests\n{\n    [Fact]\n    public void Creates() { new UserController(null); }\n}\n'),
)

#: fqn, kind, start_line, end_line, accessibility, is_test_method, complexity, nesting
SYMBOLS = (
    ('lib.shop', 'module', 1, 34, None, False, None, None),
    ('lib.shop.Base', 'class', 4, 5, 'public', False, None, None),
    ('lib.shop.Shop', 'class', 8, 27, 'public', False, None, None),
    ('lib.shop.Shop.__init__', 'method', 12, 13, 'public', False, 1, 0),
    ('lib.shop.Shop.sell', 'method', 15, 24, 'public', False, 4, 2),
    ('lib.shop.Shop._hide', 'method', 26, 27, 'private', False, 1, 0),
    ('lib.shop.test_sell', 'function', 29, 30, 'public', True, 1, 0),
    ('lib.shop.helper', 'function', 32, 33, 'public', False, 1, 0),
    ('web/cart.ts', 'module', 1, 15, None, False, None, None),
    ('web/cart.ts:Cart', 'class', 2, 9, 'export', False, None, None),
    ('web/cart.ts:Cart.ctor', 'constructor', 4, 4, None, False, 1, 0),
    ('web/cart.ts:Cart.add', 'method', 6, 8, None, False, 3, 2),
    ('web/cart.ts:Store', 'interface', 10, 10, 'export', False, None, None),
    ('web/cart.ts:Size', 'enum', 11, 11, 'export', False, None, None),
    ('web/cart.ts:Id', 'type', 12, 12, 'export', False, None, None),
    ('web/cart.ts:total', 'function', 13, 13, 'export', False, 1, 0),
    ('web/cart.ts:sum', 'function', 14, 14, None, False, 2, 0),
    ('org.bank.Bank', 'class', 4, 12, 'public', False, None, None),
    ('org.bank.Bank.ctor', 'constructor', 6, 6, 'public', False, 1, 0),
    ('org.bank.Bank.pay', 'method', 8, 11, 'protected', False, 2, 1),
    ('org.bank.Store', 'interface', 13, 13, None, False, None, None),
    ('org.bank.Kind', 'enum', 14, 14, None, False, None, None),
    ('org.bank.BankTest', 'class', 15, 18, None, False, None, None),
    ('org.bank.BankTest.paysOut', 'method', 17, 17, None, True, 1, 0),
    ('net', 'module', 1, 26, None, False, None, None),
    ('net.Dial', 'function', 6, 12, 'public', False, 2, 1),
    ('net.Conn', 'struct', 15, 17, 'public', False, None, None),
    ('net.Closer', 'interface', 19, 21, 'public', False, None, None),
    ('net.Conn.close', 'method', 23, 23, 'private', False, 1, 0),
    ('net.TestDial', 'function', 25, 25, 'public', True, 1, 0),
    ('crate::cache', 'module', 1, 21, None, False, None, None),
    ('crate::cache::Cache', 'struct', 4, 4, 'pub', False, None, None),
    ('crate::cache::Store', 'interface', 6, 6, 'pub', False, None, None),
    ('crate::cache::Store::get', 'method', 6, 6, 'private', False, None, None),
    ('crate::cache::Cache::get', 'method', 10, 12, 'private', False, 2, 1),
    ('crate::cache::Kind', 'enum', 15, 15, 'pub', False, None, None),
    ('crate::cache::fail', 'function', 17, 17, 'private', False, 1, 0),
    ('crate::cache::gets_one', 'function', 20, 20, 'private', True, 1, 0),
    ('App\\Mail\\Mail', 'class', 5, 13, 'public', False, None, None),
    ('App\\Mail\\Mail::ctor', 'constructor', 7, 7, 'public', False, 1, 0),
    ('App\\Mail\\Mail::send', 'method', 9, 12, 'public', False, 3, 2),
    ('App\\Mail\\Sender', 'interface', 14, 14, 'public', False, None, None),
    ('App\\Mail\\Sender::send', 'method', 14, 14, 'public', False, None, None),
    ('App\\Mail\\push', 'function', 15, 15, 'public', False, 1, 0),
    ('Shop.Api', 'namespace', 1, 1, None, False, None, None),
    ('Shop.Api.UserController', 'class', 3, 16, 'public', False, None, None),
    ('Shop.Api.UserController._store', 'field', 5, 5, 'private', False, None, None),
    ('Shop.Api.UserController.ctor', 'constructor', 6, 6, 'public', False, 1, 0),
    ('Shop.Api.UserController.Create', 'method', 9, 14, 'public', False, 3, 1),
    ('Shop.Api.UserController.Save', 'method', 15, 15, 'internal', False, 1, 0),
    ('Shop.Api.IUsers', 'interface', 17, 17, 'public', False, None, None),
    ('Shop.Api.CreateUserDto', 'record', 18, 18, 'public', False, None, None),
    ('Shop.Api.Kind', 'enum', 19, 19, 'public', False, None, None),
    ('Shop.Api.UserTests', 'class', 20, 24, 'public', False, None, None),
    ('Shop.Api.UserTests.Creates', 'method', 23, 23, 'public', True, 1, 0),
    ('API:POST:users', 'api_endpoint', 9, 9, None, False, None, None),
)

#: fqn, documentation
DOCUMENTATION = (
    ('lib.shop', 'Shop.'),
    ('lib.shop.Shop', 'Sells things.'),
    ('lib.shop.Shop.sell', 'Takes one.\n\nArgs:\n    n: how many'),
    ('web/cart.ts:Cart', '/** Holds items. */'),
    ('web/cart.ts:Cart.add', '/** Adds one. */'),
    ('org.bank.Bank', '/** Keeps accounts. */'),
    ('org.bank.Bank.pay', '/** Pays out. */'),
    ('net.Dial', '// Dial opens a line.'),
    ('net.Conn', '// Conn is open.'),
    ('crate::cache::Cache', '/// Keeps pages.'),
    ('crate::cache::Cache::get', '/// Gets one.'),
    ('App\\Mail\\Mail', '/** Sends mail. */'),
    ('App\\Mail\\Mail::send', '/** Sends one. */'),
    ('Shop.Api.UserController', '/// <summary>Users.</summary>'),
    ('Shop.Api.UserController.Create', '/// <summary>Creates one.</summary>'),
)

#: from_fqn, to_fqn, type
EDGES = (
    ('lib.shop', 'json', 'DependsOn'),
    ('lib.shop', 'lib.shop.Base', 'Declares'),
    ('lib.shop', 'lib.shop.Shop', 'Declares'),
    ('lib.shop.Shop', 'Base', 'Inherits'),
    ('lib.shop.Shop', 'lib.shop.Shop.__init__', 'HasMethod'),
    ('lib.shop.Shop.__init__', 'Store', 'UsesType'),
    ('lib.shop.Shop', 'lib.shop.Shop.sell', 'HasMethod'),
    ('lib.shop.Shop.sell', 'int', 'UsesType'),
    ('lib.shop.Shop.sell', 'range', 'Calls'),
    ('lib.shop.Shop.sell', 'lib.shop.Shop.log', 'Calls'),
    ('lib.shop.Shop.sell', 'SoldOut', 'Throws'),
    ('lib.shop.Shop.sell', 'SoldOut', 'Calls'),
    ('lib.shop.Shop', 'lib.shop.Shop._hide', 'HasMethod'),
    ('lib.shop', 'lib.shop.test_sell', 'Declares'),
    ('lib.shop.test_sell', 'lib.shop.helper', 'TestCovers'),
    ('lib.shop', 'lib.shop.helper', 'Declares'),
    ('lib.shop.helper', 'json.dumps', 'Calls'),
    ('web/cart.ts', 'web/cart.ts:Cart', 'Declares'),
    ('web/cart.ts:Cart', 'Base', 'Inherits'),
    ('web/cart.ts:Cart', 'Store', 'Implements'),
    ('web/cart.ts:Cart', 'web/cart.ts:Cart.ctor', 'HasConstructor'),
    ('web/cart.ts:Cart', 'web/cart.ts:Cart.add', 'HasMethod'),
    ('web/cart.ts', 'web/cart.ts:Store', 'Declares'),
    ('web/cart.ts', 'web/cart.ts:Size', 'Declares'),
    ('web/cart.ts', 'web/cart.ts:Id', 'Declares'),
    ('web/cart.ts', 'web/cart.ts:total', 'Declares'),
    ('web/cart.ts', 'web/cart.ts:sum', 'Declares'),
    ('web/cart.ts:Cart.add', 'log', 'Calls'),
    ('web/cart.ts:total', 'web/cart.ts:sum', 'Calls'),
    ('org.bank', 'org.bank.Bank', 'Declares'),
    ('org.bank.Bank', 'Base', 'Inherits'),
    ('org.bank.Bank', 'Store', 'Implements'),
    ('org.bank.Bank', 'org.bank.Bank.ctor', 'HasConstructor'),
    ('org.bank.Bank', 'Ledger', 'DependsOn'),
    ('org.bank.Bank', 'org.bank.Bank.pay', 'HasMethod'),
    ('org.bank.Bank', 'Receipt', 'UsesType'),
    ('org.bank', 'org.bank.Store', 'Declares'),
    ('org.bank', 'org.bank.Kind', 'Declares'),
    ('org.bank', 'org.bank.BankTest', 'Declares'),
    ('org.bank.BankTest', 'org.bank.BankTest.paysOut', 'HasMethod'),
    ('org.bank', 'java.util.List', 'DependsOn'),
    ('org.bank.Bank.pay', 'log', 'Calls'),
    ('org.bank.Bank.pay', 'IllegalStateException', 'Creates'),
    ('org.bank.BankTest.paysOut', 'Bank', 'Creates'),
    ('org.bank.BankTest.paysOut', 'org.bank.Bank.pay', 'TestCovers'),
    ('org.bank.Bank.pay', 'IllegalStateException', 'Throws'),
    ('net', 'net.Dial', 'Declares'),
    ('net', 'net.Conn', 'Declares'),
    ('net', 'net.Closer', 'Declares'),
    ('net.Conn', 'net.Conn.close', 'HasMethod'),
    ('net', 'net.TestDial', 'Declares'),
    ('net', 'fmt', 'DependsOn'),
    ('net.Dial', 'Println', 'Calls'),
    ('net.Conn.close', 'net.Dial', 'Calls'),
    ('net.TestDial', 'net.Dial', 'TestCovers'),
    ('crate::cache', 'crate::cache::Cache', 'Declares'),
    ('crate::cache', 'crate::cache::Store', 'Declares'),
    ('crate::cache::Store', 'crate::cache::Store::get', 'HasMethod'),
    ('crate::cache::Cache', 'Store', 'Implements'),
    ('crate::cache::Cache', 'crate::cache::Cache::get', 'HasMethod'),
    ('crate::cache', 'crate::cache::Kind', 'Declares'),
    ('crate::cache', 'crate::cache::fail', 'Declares'),
    ('crate::cache', 'crate::cache::gets_one', 'Declares'),
    ('crate::cache', 'std::fmt', 'DependsOn'),
    ('crate::cache::Cache::get', 'crate::cache::fail', 'Calls'),
    ('crate::cache::gets_one', 'crate::cache::fail', 'TestCovers'),
    ('App\\Mail', 'App\\Mail\\Mail', 'Declares'),
    ('App\\Mail\\Mail', 'Base', 'Inherits'),
    ('App\\Mail\\Mail', 'Sender', 'Implements'),
    ('App\\Mail\\Mail', 'App\\Mail\\Mail::ctor', 'HasConstructor'),
    ('App\\Mail\\Mail', 'App\\Mail\\Mail::send', 'HasMethod'),
    ('App\\Mail', 'App\\Mail\\Sender', 'Declares'),
    ('App\\Mail\\Sender', 'App\\Mail\\Sender::send', 'HasMethod'),
    ('App\\Mail', 'App\\Mail\\push', 'Declares'),
    ('App\\Mail', 'App\\Core\\Base', 'DependsOn'),
    ('App\\Mail\\Mail::send', 'App\\Mail\\push', 'Calls'),
    ('Shop.Api', 'Shop.Api.UserController', 'Declares'),
    ('Shop.Api.UserController', 'ControllerBase', 'Inherits'),
    ('Shop.Api.UserController', 'IUsers', 'Implements'),
    ('Shop.Api.UserController', 'Shop.Api.UserController._store', 'HasField'),
    ('Shop.Api.UserController', 'IStore', 'UsesType'),
    ('Shop.Api.UserController', 'Shop.Api.UserController.ctor', 'HasConstructor'),
    ('Shop.Api.UserController', 'IStore', 'DependsOn'),
    ('Shop.Api.UserController', 'Shop.Api.UserController.Create', 'HasMethod'),
    ('Shop.Api.UserController', 'UserDto', 'UsesType'),
    ('Shop.Api.UserController', 'Shop.Api.UserController.Save', 'HasMethod'),
    ('Shop.Api', 'Shop.Api.IUsers', 'Declares'),
    ('Shop.Api', 'Shop.Api.CreateUserDto', 'Declares'),
    ('Shop.Api', 'Shop.Api.Kind', 'Declares'),
    ('Shop.Api', 'Shop.Api.UserTests', 'Declares'),
    ('Shop.Api.UserTests', 'Shop.Api.UserTests.Creates', 'HasMethod'),
    ('Shop.Api.UserController.Create', 'ArgumentException', 'Creates'),
    ('Shop.Api.UserController.Create', 'Shop.Api.UserController.Save', 'Calls'),
    ('Shop.Api.UserController.Create', 'Ok', 'Calls'),
    ('Shop.Api.UserController.Save', 'Put', 'Calls'),
    ('Shop.Api.UserTests.Creates', 'UserController', 'Creates'),
    ('Shop.Api.UserController.Create', 'ArgumentException', 'Throws'),
    ('Shop.Api.UserController.Create', 'IOException', 'Catches'),
    ('API:POST:users', 'Shop.Api.UserController.Create', 'HandledBy'),
    ('API:POST:users', 'CreateUserDto', 'AcceptsDto'),
    ('API:POST:users', 'UserDto', 'ReturnsDto'),
)
